"""Rescoring of what changed: who depends on what, from narrow comparisons of two snapshots.

A product's score depends on its own columns, on its supplier's eligibility and
score, on its currency's rate and on the version of rules and configuration. A
supplier's depends on its own columns and on how many relevant products it has. So a
change runs: products that differ -> counts of the suppliers they leave and join ->
suppliers that differ -> their products. Only stale rows meet the costly rules; the
result equals a full job over the later snapshot.

Comparisons read key and fingerprint alone; the stored results are joined by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions import config as C
from souk.operators import scoring, upsert
from souk.session import written


def relevant_counts(products: DataFrame, group: str = "supplier_key") -> DataFrame:
    """Rows per group: ``group, n``; rows without a group are not counted."""
    return products.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))


def with_fingerprint(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("fingerprint", upsert.fingerprint(df, [c for c in df.columns if c not in (key, "fingerprint")]))


def differing(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys whose fingerprints differ, with ``was`` and ``now`` (false: no such row)."""
    b = before.select(F.col(key).alias("_k"), F.col("fingerprint").alias("_f"), F.lit(True).alias("_was"))
    a = after.select(key, "fingerprint", F.lit(True).alias("_now"))
    met = a.join(b, F.col(key) == F.col("_k"), "full_outer").where(~F.col("fingerprint").eqNullSafe(F.col("_f")))
    return met.select(F.coalesce(key, "_k").alias(key), F.coalesce("_was", F.lit(False)).alias("was"), F.coalesce("_now", F.lit(False)).alias("now"))


def shifted_counts(counts: DataFrame, before: DataFrame, after: DataFrame, changed: DataFrame, key: str, group: str = "supplier_key") -> DataFrame:
    """Counts brought up to date from the changed rows alone: each leaves its old group and joins its new one. Groups without rows stay, with 0."""
    keys = changed.select(F.col(key).alias("_k"))
    side = lambda df, step: df.select(key, group).join(keys, F.col(key) == F.col("_k"), "left_semi").where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.lit(step).alias("_d"))
    moved = side(before, -1).unionByName(side(after, 1)).groupBy("_g").agg(F.sum("_d").alias("_d"))
    met = counts.join(moved, F.col(group) == F.col("_g"), "full_outer")
    return met.select(F.coalesce(group, "_g").alias(group), (F.coalesce("n", F.lit(0)) + F.coalesce("_d", F.lit(0))).alias("n"))


def rescore_suppliers(suppliers: DataFrame, stored: DataFrame, cfg: C.Config) -> tuple[DataFrame, DataFrame]:
    """(all suppliers scored, those scored now). suppliers: inputs with fingerprint; stored: an earlier result, with the fingerprint it was scored from."""
    old = stored.select(F.col("supplier_key").alias("_k"), F.col("fingerprint").alias("_f"))
    stale = written(suppliers.join(old, (F.col("supplier_key") == F.col("_k")) & (F.col("fingerprint") == F.col("_f")), "left_anti"))
    scored = written(scoring.score_suppliers(stale, cfg))
    same = stored.join(suppliers.select(F.col("supplier_key").alias("_k"), F.col("fingerprint").alias("_f")), (F.col("supplier_key") == F.col("_k")) & (F.col("fingerprint") == F.col("_f")), "left_semi")
    return same.unionByName(scored), scored


def moved_suppliers(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys of suppliers whose eligibility or score is not what it was, new and gone ones with them."""
    mark = lambda df: df.select("supplier_key", F.concat_ws("|", "eligibility", F.col("supplier_score").cast("string")).alias("fingerprint"))
    return differing(mark(before), mark(after), "supplier_key").select("supplier_key")


def stale_products(products: DataFrame, stored: DataFrame, changed: DataFrame, suppliers: DataFrame, version: str, currencies: DataFrame | None = None) -> DataFrame:
    """Products that must be scored: changed ones, those of moved suppliers or of currencies whose rate moved, and those whose stored score is missing or of another version."""
    hit = lambda df, c, name: df.select(F.col(c).alias(f"_{name}"), F.lit(True).alias(name)).distinct()
    met = products.join(hit(changed, "product_key", "c1"), F.col("product_key") == F.col("_c1"), "left")
    met = met.join(hit(suppliers, "supplier_key", "c2"), F.col("supplier_key") == F.col("_c2"), "left")
    met = met.join(hit(stored.where(F.col("score_version") == version), "product_key", "c3"), F.col("product_key") == F.col("_c3"), "left")
    stale = F.col("c1").isNotNull() | F.col("c2").isNotNull() | F.col("c3").isNull()
    if currencies is not None:
        met = met.join(hit(currencies, "currency", "c4"), F.col("currency") == F.col("_c4"), "left")
        stale = stale | F.col("c4").isNotNull()
    return met.where(stale).select(products.columns)


def moved_rates(before: DataFrame, after: DataFrame) -> DataFrame:
    """Currencies whose rate differs, is new or gone."""
    mark = lambda df: df.select("currency", F.col("rate").cast("string").alias("fingerprint"))
    return differing(mark(before), mark(after), "currency").select("currency")


def rescore_products(products: DataFrame, suppliers: DataFrame, stored: DataFrame, stale: DataFrame, rates: DataFrame | None, cfg: C.Config, version: str) -> DataFrame:
    """The scored snapshot of products: stale ones scored now, the others as stored; rows that are gone, go."""
    now = scoring.score_products(stale, suppliers, rates, cfg).withColumn("score_version", F.lit(version))
    keys = products.select(F.col("product_key").alias("_k"))
    fresh = stored.join(keys, F.col("product_key") == F.col("_k"), "left_semi").join(stale.select(F.col("product_key").alias("_s")), F.col("product_key") == F.col("_s"), "left_anti")
    return fresh.unionByName(now)
