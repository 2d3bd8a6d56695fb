"""Continuous ingest of landed pages, and the change log as a stream.

Rows carry (page_no, pos), their sequence. A micro-batch is upserted into the buckets
of the store that its keys fall in (:class:`souk.sources.store.Store`); of a key's rows
the one of highest sequence is stored. *Rule for late rows*: a row whose sequence is not
above the stored one is dropped, from store and log alike, so no watermark is needed.

The log is a function of each key's rows in sequence, seeded with the stored one:
every row whose fingerprint differs from the row before it is a change, and a key's
first row is a New Product. Pages that arrive in order therefore give one and the same
log, however they are cut into files and batches, and batches that run again write it
again.

A batch is put in sequence once, for log and store. A key with very many rows in it is
compared within spans of pages, and across them by each span's last row; all other keys
in one sort. Of rows with equal key and sequence the one of largest
fingerprint counts; rows without a key are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.operators import upsert
from souk.sources.store import Store

SPAN = 64
HOT = 1 << 16  # rows of a key in a batch from which on it is taken apart by spans


def sequence() -> F.Column:
    return F.struct("page_no", "pos")


def stored_schema(source: T.StructType) -> T.StructType:
    return T.StructType([*[T.StructField(f.name, f.dataType) for f in source], T.StructField("fingerprint", T.StringType())])


def _in_order(rows: DataFrame, names: list[str], by: list[str], at: F.Column | None = None) -> DataFrame:
    """Stored rows and the batch's rows above them, of equal sequence the one of largest fingerprint; with ``_before``, the row before it under the same ``by``, and ``_last``. One exchange, one sort."""
    w = Window.partitionBy(*by).orderBy("page_no", "pos", "fingerprint")
    held = F.max(F.when(~F.col("_new"), sequence())).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = rows.withColumns({"_at": held if at is None else at, "_next": F.lead(sequence()).over(w)})
    met = met.where(~F.col("_new") | ((F.col("_at").isNull() | (sequence() > F.col("_at"))) & ~sequence().eqNullSafe(F.col("_next")))).drop("_at", "_next")
    return met.withColumns({"_before": F.lag(F.struct(*names)).over(w), "_last": F.lead(F.lit(True)).over(w).isNull()})


def in_sequence(stored: DataFrame, batch: DataFrame, key: str, tracked: list[str], span: int = SPAN, hot: int = HOT) -> DataFrame:
    """The stored rows, and (``_new``) the batch's rows above the stored sequence, one per key and sequence; with ``_before``, the key's row before this one as a struct, and ``_last``, whether it is the key's last."""
    names = stored.columns
    rows = batch.where(F.col(key).isNotNull()).select([c for c in names if c != "fingerprint"])
    rows = rows.withColumn("fingerprint", upsert.fingerprint(rows, tracked))
    every = rows.select(*names, F.lit(True).alias("_new")).unionByName(stored.select(*names, F.lit(False).alias("_new")))
    many = rows.groupBy(F.col(key).alias("_hk")).agg(F.count("*").alias("_c")).where(F.col("_c") >= hot).select("_hk")
    if many.isEmpty():
        return _in_order(every, names, [key])
    # at most a key for each ``hot`` rows of the batch, with its stored sequence
    many = F.broadcast(many.join(stored.select(F.col(key).alias("_k"), sequence().alias("_s")), F.col("_hk") == F.col("_k"), "left").select("_hk", "_s"))
    light = _in_order(every.join(many, F.col(key) == F.col("_hk"), "left_anti"), names, [key])
    dense = every.join(many, F.col(key) == F.col("_hk")).withColumn("_span", F.floor(F.col("page_no") / span))
    dense = _in_order(dense, names, [key, "_span"], F.col("_s")).select(*names, "_new", "_before", "_last", "_span")
    spans = Window.partitionBy(key).orderBy("_span")  # a row a span
    ends = dense.where("_last").select(F.col(key).alias("_ck"), F.col("_span").alias("_cs"), F.lag(F.struct(*names)).over(spans).alias("_carried"), F.lead(F.lit(True)).over(spans).isNull().alias("_end"))
    met = dense.join(ends, (F.col(key) == F.col("_ck")) & F.col("_span").eqNullSafe(F.col("_cs")))
    return light.unionByName(met.select(*names, "_new", F.coalesce("_before", "_carried").alias("_before"), (F.col("_last") & F.col("_end")).alias("_last")))


def merged(stored: DataFrame, sequenced: DataFrame, key: str) -> DataFrame:
    """:func:`merge`, of rows in sequence."""
    last = sequenced.where("_new AND _last").select(stored.columns)
    return upsert.upsert(stored, last, key, "fingerprint", [c for c in stored.columns if c not in (key, "fingerprint", "page_no", "pos")], seen=["page_no", "pos"])


def merge(stored: DataFrame, batch: DataFrame, key: str, tracked: list[str]) -> DataFrame:
    """Snapshot after a batch of rows with page_no and pos; with ``_action``."""
    return merged(stored, in_sequence(stored, batch, key, tracked), key)


def changes(sequenced: DataFrame, key: str, categories: dict[str, str]) -> DataFrame:
    """:func:`change_log`, of rows in sequence."""
    new = F.col("_before").isNull()
    differs = sequenced.where("_new").where(new | ~F.col("fingerprint").eqNullSafe(F.col("_before.fingerprint")))
    said = upsert.change_columns(categories, lambda c: F.col("_before").getField(c))
    none = {"changed_fields": F.array().cast("array<string>"), "change_type": F.lit("New Product"), "old_values": F.lit(None).cast("map<string,string>"), "new_values": F.lit(None).cast("map<string,string>")}
    out = differs.select(key, "page_no", "pos", *[F.when(new, none[n]).otherwise(c).alias(n) for n, c in said.items()])
    return out.where((F.col("change_type") == "New Product") | (F.size("changed_fields") > 0))


def change_log(stored: DataFrame, batch: DataFrame, key: str, tracked: list[str], categories: dict[str, str], span: int = SPAN, hot: int = HOT) -> DataFrame:
    """Changes that a batch makes to the stored rows, in each key's sequence: key, page_no, pos, and what :func:`upsert.change_columns` says."""
    return changes(in_sequence(stored, batch, key, tracked, span, hot), key, categories)


def ingest_stream(spark: SparkSession, landing: str, store: str, checkpoint: str, schema: T.StructType, key: str, tracked: list[str], fmt: str = "json", files_per_batch: int = 1, log: str | None = None, categories: dict[str, str] | None = None, buckets: int = 64):
    """Start ingest of all landed files (then stop). With ``log``, field-level changes are appended there, a folder per batch."""
    held = Store(spark, store, key, stored_schema(schema), buckets)

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read three times: its buckets, its hot keys, its rows
        try:
            touched = held.touched(batch)
            if not touched:
                return
            before = held.read(number, touched)
            rows = in_sequence(before, batch, key, tracked)
            rows = rows.persist() if log else rows  # read by the log and the merge
            if log:
                changes(rows, key, categories or {c: "Changed" for c in tracked}).write.mode("overwrite").parquet(f"{log}/b={number}")
            held.write(merged(before, rows, key).drop("_action"), touched, number)
            rows.unpersist()
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(landing)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_store(spark: SparkSession, store: str, schema: T.StructType, key: str) -> DataFrame:
    return Store(spark, store, key, schema).read()
