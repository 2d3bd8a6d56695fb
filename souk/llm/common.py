"""What the operators share: written intermediate tables, word splitting, connected components."""

from __future__ import annotations

import atexit
import contextlib
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches hold at most about so many bytes, so that a Python worker's memory does not depend on how long texts are.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: the session's spark.checkpoint.dir, else (single machine) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="souk-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_opened: list[str] = []


def release(spark: SparkSession, since: int) -> None:
    """Remove the workspaces opened after the first ``since``; for when what was made from them is written."""
    for root in _opened[since:]:
        _remove(spark, root)
    del _opened[since:]


def opened() -> int:
    return len(_opened)


def _remove(spark: SparkSession, where: str) -> None:
    with contextlib.suppress(Exception):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Workspace:
    """Tables written below :func:`shared_dir` to cut lineage; lost executors cost no recomputation of them.

    ``drop`` removes a table once nothing reads it, ``close`` all of them; the rest goes when Python ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self._n = 0
        _opened.append(self.root)
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "t", codec: str | None = None) -> DataFrame:
        """Write df as Parquet (by a codec, or the session's) and read it back; what it has shuffled goes at once."""
        where = self.path(name)
        with _shuffles_removed(self.spark):
            df.write.parquet(where, compression=codec)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._souk_path = where
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._remove(df._souk_path)

    def close(self) -> None:
        """Remove all its tables, once nothing reads them."""
        self._remove(self.root)
        _opened.remove(self.root)

    def _remove(self, where: str) -> None:
        _remove(self.spark, where)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run within leave no shuffle files; else these stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES``, where the session has Spark's default (64 MB)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == str(64 << 20):
        spark.conf.set(name, str(BATCH_BYTES))


def by_text(f: Callable, kind: str) -> Callable[[Column | str], Column]:
    """A column function of texts. f: a list of texts (None: null) -> an Arrow array of as many values.

    Only the text goes to Python, by Arrow; ids and all other columns stay in the JVM.
    """

    def run(texts: pa.Array) -> pa.Array:
        return f(texts.to_pylist())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def by_columns(f: Callable, kind: str) -> Callable[..., Column]:
    """A column function of several columns. f: Arrow arrays -> an Arrow array of as many values."""
    f.__annotations__ = {**dict.fromkeys(inspect.signature(f).parameters, pa.Array), "return": pa.Array}
    return F.arrow_udf(f, kind)


def listed(ends: list[int], **fields: pa.Array) -> pa.Array:
    """A list of structs for each row; ends: 0 and where each row's list ends."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns never clash."""
    return df.select(*[df[n] for n in names])


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() cuts at exactly those six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def components(ws: Workspace, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: ``a``, ``b`` (long, undirected; loops and repeats allowed). Returns
    ``node``, ``root`` for every node that has an edge to another one; the root
    is the smallest node. Each round is a grouped minimum and a join, so a hub
    never has to fit in a task; only a row count and a checksum reach the driver.
    """
    a, b = F.col("a"), F.col("b")
    now = ws.cut(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.unionByName(df.select(b.alias("a"), a.alias("b"))) if large else df
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("k", "m").alias("m"))
        met = both.join(least, both["a"] == least["k"])
        if large:
            met = met.where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        else:
            met = met.select(F.explode(F.array(F.struct(b.alias("a"), F.col("m").alias("b")), F.struct(a.alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        return met.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()

    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        after = ws.cut(star(star(now, True), False), "edges")
        found = mark(after)
        ws.drop(now)
        now = after
        if found == seen:
            return now.select(a.alias("node"), b.alias("root")).unionByName(now.select(b.alias("node"), b.alias("root")).distinct())
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(a.alias("node"), b.alias("root"))
