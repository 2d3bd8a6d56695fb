"""Byte-limited shards by extendible hashing.

A row's 60-bit hash is that of its key. The root bucket holds every row; a
bucket over the byte limit, and only such a one, splits on the next hash bit,
until each fits. Directory and buckets are tables: a pass sums the bytes of the
open buckets' rows by their next ``step`` bits, folds the sums up one bit at a
time, and closes each prefix that fits while its parent does not. Rows find
their shard by an equal join on the directory entry, their hash's first
``global_depth`` bits, as in any extendible hash table.

A single row may exceed the limit; it has a shard of its own then, if its key
is unique. Rows of equal keys share all bits: what is still too large at
``max_depth`` bits becomes a chain of pages, numbered by whole rows of a range
sort, as overflow pages are; each page but those of one row fits the limit.

Only the depth of the deepest bucket reaches the driver.

Edge cases: null sizes and texts count 0 bytes; null keys hash as one key; an
empty table has no shard; rows that repeat are placed each, on pages by key and
size; extra columns of any name do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import Workspace
from souk.llm.ranks import with_columns

HASH_BITS = 60


def key_hash(*cols: str) -> F.Column:
    """The first 60 bits of the key's MD5, as any engine computes it."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(h: F.Column, depth) -> F.Column:
    return F.shiftright(h, HASH_BITS - depth) if isinstance(depth, int) else F.call_function("shiftright", h, F.lit(HASH_BITS) - depth)


def buckets(ws: Workspace, rows: DataFrame, limit: int, step: int = 8, max_depth: int = 48) -> tuple[DataFrame, int]:
    """rows: h, bytes. Returns the buckets (depth, prefix, shard_bytes, shard_rows) and the greatest depth."""
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    if not whole["n"]:
        return ws.spark.createDataFrame([], "depth int, prefix long, shard_bytes long, shard_rows long"), 0
    if whole["b"] <= limit:
        return ws.spark.createDataFrame([(0, 0, int(whole["b"]), whole["n"])], "depth int, prefix long, shard_bytes long, shard_rows long"), 0
    # enough bits for buckets of the limit's size at once, then step by step where that is not enough
    first = min(max_depth, max(1, int(whole["b"] // limit).bit_length()))
    done, depth, opened = [], 0, None
    while depth < max_depth:
        to = min(max_depth, first if opened is None else depth + step)
        live = rows.select("h", "bytes", prefix(F.col("h"), to).alias("prefix"), prefix(F.col("h"), depth).alias("at"))
        if opened is not None:
            live = live.join(opened.select(F.col("prefix").alias("o")), F.col("at") == F.col("o"), "left_semi")
        sums = [ws.cut(live.groupBy("prefix").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")), "sums")]
        for _ in range(to - depth - 1):
            sums.append(ws.cut(sums[-1].groupBy(F.shiftright("prefix", 1).alias("prefix")).agg(F.sum("b").alias("b"), F.sum("n").alias("n")), "sums"))
        # sums[i] is of depth to - i; a bucket closes where it fits and its parent does not
        for i, s in enumerate(sums):
            fit = s.where((F.col("b") <= limit) | ((F.lit(i) == 0) & (F.lit(to) == max_depth)))
            if i + 1 < len(sums):
                up = sums[i + 1].where(F.col("b") > limit).select(F.col("prefix").alias("o"))
                fit = fit.join(up, F.shiftright("prefix", 1) == F.col("o"), "left_semi")
            done.append(fit.select(F.lit(to - i).alias("depth"), "prefix", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows")))
        opened, depth = sums[0].where(F.col("b") > limit), to
        if opened.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = ws.cut(out, "buckets")
    return out, out.agg(F.max("depth")).first()[0]


def pages(ws: Workspace, rows: DataFrame, limit: int) -> DataFrame:
    """rows (with shard, key, bytes) and ``page``: numbered in a range sort, each at most limit bytes unless of one row.

    A partition of the sort numbers its own rows and opens a new page at its start.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part int, own int"

    def number(frames):
        from pyspark import TaskContext

        part, shard, own, held = TaskContext.get().partitionId(), None, 0, 0
        for x in frames:
            at = []
            for s, b in zip(x["shard"].to_pylist(), x["bytes"].to_pylist(), strict=True):
                if s != shard:
                    shard, own, held = s, 0, 0
                elif held and held + b > limit:
                    own, held = own + 1, 0
                held += b
                at.append(own)
            yield with_columns(x, part=pa.array(np.full(len(at), part, dtype=np.int32)), own=pa.array(at, pa.int32()))

    order = ["shard", "key", "bytes"]
    laid = ws.cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), "pages")
    size = laid.groupBy("shard", "part").agg((F.max("own") + 1).alias("k"))
    before = F.sum("k").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    size = size.withColumn("base", F.coalesce(before, F.lit(0))).select(F.col("shard").alias("ps"), F.col("part").alias("pp"), "base")
    return laid.join(size, (F.col("shard") == F.col("ps")) & (F.col("part") == F.col("pp"))).withColumn("page", (F.col("own") + F.col("base")).cast("int")).drop("part", "own", "ps", "pp", "base")


def placed(df: DataFrame, keys: tuple[str, ...], size: F.Column, limit: int, max_depth: int, step: int, whole: bool) -> DataFrame:
    """``key`` (struct), ``bytes, shard, depth, page, shard_bytes, shard_rows`` and, if whole, ``doc`` (struct of all columns) for each row."""
    ws = Workspace(df.sparkSession)
    doc = [F.struct(*[df[c] for c in df.columns]).alias("doc")] if whole else []
    rows = ws.cut(df.select(F.struct(*[df[k] for k in keys]).alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"), key_hash(*keys).alias("h"), *doc), "hashes")
    found, top = buckets(ws, rows, limit, step, max_depth)
    # the directory: an entry for each prefix of top bits that a row has, pointing at its bucket
    entries = rows.select(prefix(F.col("h"), top).alias("entry")).distinct()
    depths = [r[0] for r in found.select("depth").distinct().collect()]
    if not depths:
        zero = F.lit(0).cast("long")
        return rows.drop("h").select("*", F.lit("").alias("shard"), F.lit(0).alias("depth"), zero.alias("shard_bytes"), zero.alias("shard_rows"), F.lit(0).alias("page"))
    at = entries.withColumn("d", F.explode(F.array(*[F.lit(d) for d in depths]))).withColumn("p", F.call_function("shiftright", F.col("entry"), F.lit(top) - F.col("d")))
    directory = ws.cut(at.join(found, (F.col("d") == F.col("depth")) & (F.col("p") == F.col("prefix"))).select("entry", "depth", "prefix", "shard_bytes", "shard_rows"), "directory")
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    met = rows.withColumn("e", prefix(F.col("h"), top)).join(directory, F.col("e") == F.col("entry")).select("key", "bytes", *["doc"] * whole, bits.alias("shard"), "depth", "shard_bytes", "shard_rows")
    over = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    plain = met.where(~over).withColumn("page", F.lit(0))
    if found.where(over).isEmpty():
        return plain
    return plain.unionByName(pages(ws, met.where(over), limit))


def shard(df: DataFrame, keys: tuple[str, ...], size: F.Column, limit: int, max_depth: int = 48, step: int = 8) -> DataFrame:
    """The key columns and ``bytes, shard, depth, page, shard_bytes, shard_rows`` for each row of df.

    shard: the bucket's bits as a string of 0 and 1 (empty: the root); page is 0
    but in overflow chains. shard_bytes and shard_rows are those of the bucket.
    """
    out = placed(df, keys, size, limit, max_depth, step, False)
    return out.select("key.*", "bytes", "shard", "depth", "page", "shard_bytes", "shard_rows")


def write_shards(df: DataFrame, path: str, keys: tuple[str, ...], size: F.Column, limit: int, max_depth: int = 48, step: int = 8) -> tuple[str, str]:
    """Write df below path with a folder per shard and page; gives the names of these two partition columns.

    Every row lies in its own page, so a page fits the limit unless it is of one
    row. Shards are named ``b`` and their bits, which no reader takes for numbers;
    the columns are ``shard`` and ``page``, with underscores before if df has such.
    """
    names = []
    for name in ("shard", "page"):
        while name in df.columns:
            name = "_" + name
        names.append(name)
    out = placed(df, keys, size, limit, max_depth, step, True)
    out = out.select("doc.*", F.concat(F.lit("b"), "shard").alias(names[0]), F.col("page").alias(names[1]))
    out.repartition(*names).write.partitionBy(*names).parquet(path)
    return names[0], names[1]


def sizes(placed: DataFrame) -> DataFrame:
    """Bytes and rows of each shard and page."""
    return placed.groupBy("shard", "page").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
