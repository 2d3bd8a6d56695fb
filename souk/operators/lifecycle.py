"""Stored rows: which column is set when, as data that drives the upsert.

A column is set by one or more events: ``fields`` when a row is created or its
fingerprint differs, ``create`` only on creation, ``changed`` only on a change,
``seen`` whenever the row is met. What no event names is a person's, and stays.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions import rules as R
from souk.operators import upsert


class Life(NamedTuple):
    """key; fields: stored column -> normalized one; joined: stored column -> (list, separator); flags: false where null; create, changed: literals ("@now": the run's time); tracked: what the fingerprint covers."""

    key: str
    fields: dict[str, str]
    joined: dict[str, tuple[str, str]]
    flags: tuple[str, ...]
    create: dict
    changed: dict
    seen: dict
    tracked: tuple[str, ...]


def _same(names: str) -> dict[str, str]:
    return {n: n for n in names.split()}


SEEN = {"last_seen_at": "@now", "last_scan_run": "@run"}

SUPPLIERS = Life(
    key="supplier_key",
    fields=_same("source_supplier_id supplier_name supplier_url location_country approval_required supplier_rating review_count catalog_product_count relevant_product_count shipping_min_days shipping_max_days shipping_policy_available return_policy_available contact_information_available data_completeness_pct"),
    joined={"dispatch_countries": ("dispatch_countries", ", "), "ships_to_countries": ("ships_to_countries", ", ")},
    flags=("active",),
    create={"first_seen_at": "@now", "hard_gate_status": "Unscored", "eligibility": "Unscored", "manual_override": "@override"},
    changed={"last_changed_at": "@now"},
    seen=SEEN,
    tracked=("supplier_name", "supplier_url", "location_country", "dispatch_countries", "ships_to_countries", "approval_required", "supplier_rating", "review_count", "shipping_min_days", "shipping_max_days", "shipping_policy_available", "return_policy_available", "active"),
)

PRODUCTS = Life(
    key="product_key",
    fields=_same("source_product_id product_name product_url supplier_key supplier_sku brand category subcategory description currency supplier_price suggested_retail_price shipping_cost stock_quantity variants_count main_image_url ships_from shipping_min_days shipping_max_days added_at updated_at"),
    joined={"image_urls": ("image_urls", "\n")},
    flags=("active", "shipping_cost_known"),
    create={"first_seen_at": "@now", "is_new": True, "supplier_eligible": False, "product_gate_status": "Unscored", "margin_status": "Unknown", "collection": "Unclassified", "review_status": "Unscored", "selection_status": "Not Selected"},
    changed={"last_changed_at": "@now", "is_new": False},
    seen=SEEN,
    tracked=("product_name", "description", "supplier_price", "suggested_retail_price", "shipping_cost", "shipping_min_days", "shipping_max_days", "stock_status", "stock_quantity", "main_image_url", "image_urls", "variants_count", "supplier_key", "active", "category", "subcategory"),
)


def store_rows(df: DataFrame, life: Life, raw: Column | None = None) -> DataFrame:
    """Normalized records in the stored shape: mapped columns, joined lists, stock words, flags, ``raw``, ``source_label``, ``fingerprint`` of the tracked values."""
    joined = [F.when(F.size(c) > 0, F.array_join(c, sep)).alias(n) for n, (c, sep) in life.joined.items()]
    held = lambda n, kind: F.col(n) if n in df.columns else F.lit(None).cast(kind)
    stock = [R.stock_status(F.col("stock_status")).alias("stock_status")] if "stock_status" in df.columns else []
    out = [F.col(life.key), *[held(c, "long").alias(n) for n, c in life.fields.items()], *joined, *stock, *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in life.flags]]
    override = [F.coalesce(held("manual_override", "string"), F.lit("None")).alias("_override")]
    return df.select(*out, *override, (raw if raw is not None else held("raw", "string")).alias("raw"), held("source_label", "string").alias("source_label"), upsert.fingerprint(df, list(life.tracked)).alias("fingerprint"))


def _values(sets: dict, now: str, run: str) -> dict[str, Column]:
    special = {"@now": F.lit(now).cast("timestamp"), "@run": F.lit(run), "@override": F.col("__override")}
    return {n: special[v] if isinstance(v, str) and v in special else F.lit(v) for n, v in sets.items()}


def empty(rows: DataFrame, life: Life) -> DataFrame:
    """A stored table without rows, for rows of :func:`store_rows`."""
    kinds = {**dict.fromkeys([*life.create, *life.changed, *life.seen], "string"), **{n: "timestamp" for n in ("first_seen_at", "last_seen_at", "last_changed_at")}, "is_new": "boolean", "supplier_eligible": "boolean"}
    more = [F.lit(None).cast(kinds[n]).alias(n) for n in dict.fromkeys([*life.create, *life.changed, *life.seen]) if n not in rows.columns]
    return rows.drop("_override").select("*", *more).limit(0)


def store(target: DataFrame, rows: DataFrame, life: Life, now: str, run: str) -> DataFrame:
    """The stored table after a scan, with ``_action``. A row without ``source_label`` leaves the stored one; rows without a key are left out, of several of a key the largest counts."""
    rows = rows.where(F.col(life.key).isNotNull())
    rows = upsert.dedupe_last(rows, life.key, ["fingerprint", "raw"])
    label = {"source_label": F.coalesce("_source_label", "source_label")}
    values = [c for c in rows.columns if c not in (life.key, "fingerprint", "_override")]
    create, changed = _values(life.create, now, run), _values(life.changed, now, run)
    return upsert.upsert(target, rows, life.key, "fingerprint", [*values, "_override"], create=create | label, changed=changed | label, touch=_values(life.seen, now, run))
