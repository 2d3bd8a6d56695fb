"""Idempotent upserts by key and fingerprint, change capture, reconciliation, run ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.functions import config as C


def dedupe_last(df: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key in the given order (null keys are one key); an aggregate, which combines before the shuffle."""
    last = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")
    return df.groupBy(F.col(key).alias("_k")).agg(last).select("_r.*")


def fingerprint(df: DataFrame, cols: list[str]) -> Column:
    """SHA-256 over the named columns; the order in a list does not matter, null differs from empty."""
    kinds = {f.name: f.dataType for f in df.schema}
    def one(c: str) -> Column:
        v = F.array_join(F.array_sort(F.col(c).cast("array<string>")), "\x1e") if isinstance(kinds[c], T.ArrayType) else F.col(c).cast("string")
        return F.coalesce(v, F.lit("\x00"))

    return F.sha2(F.concat_ws("\x1f", *[one(c) for c in cols]), 256)


def index(df: DataFrame, key: str, mark: str) -> DataFrame:
    """Key and fingerprint alone."""
    return df.select(key, mark)


def upsert(target: DataFrame, incoming: DataFrame, key: str, mark: str, values: list[str], create: dict[str, Column] | None = None, changed: dict[str, Column] | None = None, touch: dict[str, Column] | None = None, seen: list[str] | tuple = ()) -> DataFrame:
    """New snapshot with ``_action`` (created, updated, unchanged, untouched).

    ``values`` and ``mark`` come from incoming where the fingerprint differs, ``seen``
    columns for every row seen; ``create`` sets columns of new rows, ``changed`` of
    updated ones, ``touch`` of every row seen. Keys of incoming are unique (:func:`dedupe_last`).
    """
    new = incoming.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in [mark, *values, *seen]], F.lit(True).alias("_in"))
    old = target.withColumn("_had", F.lit(True))
    met = old.join(new, F.col(key) == F.col("_k"), "full_outer")
    action = F.when(F.col("_in").isNull(), "untouched").when(F.col("_had").isNull(), "created").when(F.col(mark).eqNullSafe(F.col(f"_{mark}")), "unchanged").otherwise("updated")
    met = met.withColumn("_action", action)
    fresh = F.col("_action").isin("created", "updated")
    out = []
    for c in target.columns:
        v = F.coalesce(F.col(key), F.col("_k")) if c == key else F.when(fresh, F.col(f"_{c}")).otherwise(F.col(c)) if c in [mark, *values] else F.col(c)
        if c in seen:
            v = F.when(F.col("_in").isNotNull(), F.col(f"_{c}")).otherwise(v)
        if create and c in create:
            v = F.when(F.col("_action") == "created", create[c]).otherwise(v)
        if changed and c in changed:
            v = F.when(F.col("_action") == "updated", changed[c]).otherwise(v)
        if touch and c in touch:
            v = F.when(F.col("_in").isNotNull(), touch[c]).otherwise(v)
        out.append(v.alias(c))
    return met.select(*out, "_action")


def upsert_into(store, incoming: DataFrame, mark: str, values: list[str], number: int | None = None, **sets) -> DataFrame:
    """:func:`upsert` into a :class:`souk.sources.store.Store`: reads and writes only the buckets that incoming's keys fall in.

    Gives what the batch did, a row a key of these buckets with ``_action``. Incoming is
    read twice (its buckets, then its rows): a table, not a long plan.
    """
    number = store.newest() + 1 if number is None else number
    touched = store.touched(incoming)
    after = upsert(store.read(number, touched), incoming, store.key, mark, values, **sets)
    store.write(after, touched, number)
    return store.written(number, after.schema)


def store_records(target: DataFrame, incoming: DataFrame, key: str, mark: str, values: list[str], initial: dict[str, str], on_change: dict[str, str], seen: dict[str, str]) -> DataFrame:
    """Upsert of mapped records: ``initial`` values on creation, ``on_change`` ones where the fingerprint differs, ``seen`` ones for every row met; what a person set otherwise stays."""
    lit = lambda d: {c: F.lit(v) for c, v in d.items()}
    return upsert(target, incoming, key, mark, values, create=lit(initial), changed=lit(on_change), touch=lit(seen))


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both, of the first alone, and of any: ``kind`` (both, first, any), key."""
    a, b = a.select(key), b.select(key)
    out = None
    for kind, df in (("both", a.intersect(b)), ("first", a.subtract(b)), ("any", a.union(b).distinct())):
        one = df.select(F.lit(kind).alias("kind"), key)
        out = one if out is None else out.unionByName(one)
    return out


def change_columns(categories: dict[str, str], old) -> dict[str, Column]:
    """What differs between a row and an older one: changed fields, change type (one category, else Multiple), old and new values as maps of text.

    old: name -> the older row's column.
    """
    differing = lambda value: F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(old(c)), value(c)) for c in categories]))
    fields, kinds = differing(F.lit), F.array_distinct(differing(lambda c: F.lit(categories[c])))
    values = lambda of: F.map_from_entries(differing(lambda c: F.struct(F.lit(c), of(c).cast("string"))))
    return {"changed_fields": fields, "change_type": F.when(F.size(kinds) == 1, kinds[0]).otherwise("Multiple"), "old_values": values(old), "new_values": values(F.col)}


def detect_changes(prev: DataFrame, cur: DataFrame, key: str, mark: str, categories: dict[str, str]) -> DataFrame:
    """Per changed key of two snapshots: :func:`change_columns`."""
    p = prev.select(F.col(key).alias("_k"), F.col(mark).alias("_m"), *[F.col(c).alias(f"_{c}") for c in categories])
    met = cur.join(p, F.col(key) == F.col("_k")).where(~F.col(mark).eqNullSafe(F.col("_m")))  # equal fingerprints: no wide comparison
    said = change_columns(categories, lambda c: F.col(f"_{c}"))
    return met.select(key, *[c.alias(n) for n, c in said.items()]).where(F.size("changed_fields") > 0)


def missing_keys(known: DataFrame, seen: DataFrame, key: str, seen_key: str | None = None) -> DataFrame:
    s = seen.select(F.col(seen_key or key).alias("_s")).distinct()
    return known.join(s, F.col(key) == F.col("_s"), "left_anti")


def new_keys(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return missing_keys(incoming, target, key).select(key).distinct()


def reconcile(target: DataFrame, seen: DataFrame, key: str, run_ok: bool, source: Column | None = None) -> DataFrame:
    """Rows not seen become inactive and Archived with fingerprint ``archived``, if the run completed; nothing is deleted.

    source: which rows the run covered (all, if none).
    """
    if not run_ok:
        return target
    s = seen.select(F.col(key).alias("_s"), F.lit(True).alias("_seen")).distinct()
    gone = F.col("_seen").isNull() & (source if source is not None else F.lit(True))
    new = {"active": F.lit(False), "selection_status": F.lit("Archived"), "fingerprint": F.lit("archived")}
    return target.join(s, F.col(key) == F.col("_s"), "left").select(*[F.when(gone, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in target.columns])


def decide(df: DataFrame, decisions: DataFrame, key: str, status: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply ``decision`` (approve or reject) by key: new rows, audit rows with previous status and actor, decisions without a row."""
    d = decisions.select(F.col(key).alias("_k"), "decision", "actor", "note")
    to = F.when(F.col("decision") == "approve", "Manually Approved").when(F.col("decision") == "reject", "Manually Rejected")
    met = df.join(d, F.col(key) == F.col("_k"), "left")
    rows = met.select(*[F.coalesce(to, F.col(c)).alias(c) if c == status else F.col(c) for c in df.columns])
    audit = df.join(d, F.col(key) == F.col("_k")).select(F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), "decision", "actor"), 256), 1, 20).alias("decision_id"), F.col(key), F.col(status).alias("previous_status"), to.alias("new_status"), "actor", "note")
    return rows, audit, d.join(df, F.col("_k") == F.col(key), "left_anti").select(F.col("_k").alias(key), "decision")


def apply_supplier_overrides(suppliers: DataFrame, decisions: DataFrame, cfg: C.Config) -> tuple[DataFrame, DataFrame]:
    """Set ``manual_override`` by supplier key, score again, and give the audit rows."""
    from souk.operators import scoring

    d = decisions.select(F.col("supplier_key").alias("_k"), "override", "actor")
    met = suppliers.join(d, F.col("supplier_key") == F.col("_k"), "left")
    out = met.select(*[c for c in suppliers.columns if c != "manual_override"], F.coalesce("override", F.col("manual_override") if "manual_override" in suppliers.columns else F.lit("None")).alias("manual_override"))
    audit = met.where(F.col("_k").isNotNull()).select("supplier_key", F.col("override").alias("decision"), "actor")
    return scoring.score_suppliers(out, cfg), audit


def set_status(df: DataFrame, keys: DataFrame, key: str, col: str, value: str) -> DataFrame:
    k = keys.select(F.col(key).alias("_k"), F.lit(True).alias("_hit")).distinct()
    return df.join(k, F.col(key) == F.col("_k"), "left").select(*[F.when(F.col("_hit"), value).otherwise(F.col(c)).alias(c) if c == col else F.col(c) for c in df.columns])


def preserve_manual(df: DataFrame, status: str, rescored: Column) -> DataFrame:
    """A new status, except where a person has decided."""
    return df.withColumn(status, F.when(F.col(status).isin(*C.MANUAL_STATUSES), F.col(status)).otherwise(rescored))


def reset_candidates(df: DataFrame, col: str, status: str) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col) == status, "Not Selected").otherwise(F.col(col)))


def enrich(products: DataFrame, details: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Detail values over stored ones, where there are any; the key stays."""
    from souk.sources.pages import patch

    return patch(products, details.select(key, *fields), key, "keep")


def enrich_suppliers(suppliers: DataFrame, details: DataFrame, key: str, fields: list[str], rank: list) -> DataFrame:
    """The first detail row of each supplier (by rank), where it has values."""
    from souk.sources.pages import patch

    first = details.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(*rank)).alias("_r")).select(key, "_r.*")
    return patch(suppliers, first, key, "keep")


def early_stop(rows: DataFrame, known: DataFrame, key: str, page: str, pos: str, n: int, m: int) -> DataFrame:
    """Rows up to the page at whose end n consecutive known rows or m consecutive fully known pages have been met.

    A row is known if its key is indexed or stood on an earlier page; pages are
    numbers. Order is total over the scan, so counters are running sums and maxima
    of per-page facts, taken within spans of pages and carried over between them:
    one task sees a row per span, none sees all pages.
    """
    k = known.select(F.col(key).alias("_k"), F.lit(True).alias("_known")).distinct()
    first = rows.groupBy(F.col(key).alias("_f")).agg(F.min(page).alias("_first"))
    met = rows.join(k, F.col(key) == F.col("_k"), "left").join(first, F.col(key) == F.col("_f")).withColumn("_new", F.col("_known").isNull() & (F.col("_first") == F.col(page)))
    pages = met.groupBy(page).agg(F.max(F.when(F.col("_new"), F.col(pos))).alias("last_new"), F.count_if("_new").alias("news"))
    # known rows after the page's last new one
    tail = met.join(pages.select(F.col(page).alias("_p"), "last_new"), F.col(page) == F.col("_p")).where(F.col("last_new").isNull() | (F.col(pos) > F.col("last_new"))).groupBy(F.col(page).alias("_p")).agg(F.count("*").alias("tail"))
    pages = pages.join(tail, F.col(page) == F.col("_p"), "left").select(page, "news", F.coalesce("tail", F.lit(0)).alias("tail"))
    pages = running(pages, page, {"rows": (F.sum, F.col("tail")), "pages": (F.sum, (F.col("news") == 0).cast("long"))})
    # both counters start anew on a page with news
    anew = F.col("news") > 0
    pages = running(pages, page, {"rows0": (F.max, F.when(anew, F.col("rows") - F.col("tail"))), "pages0": (F.max, F.when(anew, F.col("pages")))})
    met_all = (F.col("rows") - F.coalesce("rows0", F.lit(0)) >= n) | (F.col("pages") - F.coalesce("pages0", F.lit(0)) >= m)
    cut = pages.where(met_all).agg(F.min(page).alias("_cut"))
    return rows.join(F.broadcast(cut), F.col("_cut").isNull() | (F.col(page) <= F.col("_cut"))).drop("_cut")  # one row


def running(df: DataFrame, order: str, columns: dict, span: int = 4096) -> DataFrame:
    """df with running values: name -> (aggregate: F.sum or F.max, column), over all rows up to this one by ``order``, a number that is unique."""
    df = df.withColumn("_span", F.floor(F.col(order) / span))
    whole = df.groupBy("_span").agg(*[f(c).alias(n) for n, (f, c) in columns.items()])
    earlier = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # a row per span
    whole = whole.select(F.col("_span").alias("_of"), *[f(n).over(earlier).alias("_before_" + n) for n, (f, _) in columns.items()])
    within = Window.partitionBy("_span").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.select("*", *[f(c).over(within).alias(n) for n, (f, c) in columns.items()]).join(whole, F.col("_span") == F.col("_of"))
    join = {F.sum: lambda a, b: a + F.coalesce(b, F.lit(0)), F.max: F.greatest}
    return out.select(*[c for c in df.columns if c != "_span"], *[join[f](F.col(n), F.col("_before_" + n)).alias(n) for n, (f, _) in columns.items()])


def completeness_status(status: Column, verified: Column, stopped: Column) -> Column:
    return F.when(status != "Completed", "Incomplete").when(stopped & verified, "Verified Incremental").when(stopped, "Unverified Incremental").otherwise("Complete")


def run_counts(result: DataFrame, run_id: str, config_hash: str, version: str) -> DataFrame:
    """One ledger row from an upsert's actions."""
    a = lambda v: F.count_if(F.col("_action") == v).alias(v)
    return result.agg(F.count_if(F.col("_action") != "untouched").alias("seen"), a("created"), a("updated"), a("unchanged")).select(F.lit(run_id).alias("run_id"), F.lit(config_hash).alias("config_hash"), F.lit(version).alias("version"), "*")


def runs(ledger: DataFrame, limit: int) -> DataFrame:
    """Newest runs first, with whether they can be resumed."""
    return ledger.withColumn("resumable", F.col("status").isin("Running", "Failed", "Partial") & F.col("cursor").isNotNull()).orderBy(F.desc("started_at"), "run_id").limit(limit)


def show_run(ledger: DataFrame, run_id: str) -> DataFrame:
    """One run's row; none for an unknown id."""
    return ledger.where(F.col("run_id") == run_id)


def latest_run(ledger: DataFrame, kind: str | None = None) -> DataFrame:
    """The newest run (of a kind), of equal starts the one with the largest id."""
    out = ledger if kind is None else ledger.where(F.col("kind") == kind)
    return out.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def open_run(ledger: DataFrame, run_id: str, kind: str, started_at: str) -> DataFrame:
    row = ledger.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), F.lit("Running").alias("status"), F.lit(started_at).alias("started_at"))
    return ledger.unionByName(row, allowMissingColumns=True)


def close_run(ledger: DataFrame, run_id: str, status: str, completeness: str, error: str | None = None) -> DataFrame:
    hit = F.col("run_id") == run_id
    out = ledger
    for c, v in (("status", status), ("completeness", completeness), ("error", error)):
        old = F.col(c) if c in ledger.columns else F.lit(None).cast("string")
        out = out.withColumn(c, F.when(hit, F.lit(v)).otherwise(old))
    return out


def append_log(log: DataFrame, rows: DataFrame, run_id: str, key: str) -> DataFrame:
    """Rows with ids that a replay repeats; ids the log has already are not added twice."""
    ids = rows.withColumn("log_id", F.substring(F.sha2(F.concat_ws("|", F.lit(run_id), F.col(key).cast("string")), 256), 1, 20))
    return log.unionByName(ids.join(log.select(F.col("log_id").alias("_l")), F.col("log_id") == F.col("_l"), "left_anti"), allowMissingColumns=True)


def snapshot_diff(prev: DataFrame, cur: DataFrame, key: str) -> DataFrame:
    return missing_keys(cur, prev, key).select(key, F.lit("added").alias("side")).unionByName(missing_keys(prev, cur, key).select(key, F.lit("removed").alias("side")))


def since(df: DataFrame, ts: str, cutoff: str) -> DataFrame:
    return df.where(F.col(ts) > F.lit(cutoff).cast("timestamp"))


def needs_rescore(products: DataFrame, suppliers: DataFrame, version: str) -> DataFrame:
    """Products changed since their score, of another score version, or of a supplier whose eligibility changed since."""
    s = suppliers.select(F.col("supplier_key").alias("_s"), F.col("eligibility_changed_at").alias("_e"))
    stale = (F.col("changed_at") > F.col("scored_at")) | F.col("scored_at").isNull() | (F.col("score_version") != version) | (F.col("_e") > F.col("scored_at"))
    return products.join(s, F.col("supplier_key") == F.col("_s"), "left").where(F.coalesce(stale, F.lit(True))).select(products.columns)


def previous_state(target: DataFrame, raw: str, key: str, paths: dict[str, str]) -> DataFrame:
    """Fields of stored raw JSON by dotted path; rows whose JSON is bad or that have no key are left out."""
    from souk.sources.pages import map_paths

    good = F.try_parse_json(F.col(raw)).isNotNull() & F.col(key).isNotNull()
    return map_paths(target.where(good), raw, paths)
