"""A keyed table in buckets, of which a batch reads and writes only those that its keys fall in.

Rows lie in ``v<number>/bucket=<k>``, k a hash of the key; a small manifest a batch,
``m<number>``, says which version of each bucket holds. A batch that runs again reads
the manifest before its own and writes the same version, so replays change nothing. The
manifests of the last two batches are kept, with the versions they name; others go, and
version folders with them. So a batch's work, on the driver too, is bounded by the
buckets, not by the batches before it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.session import remove


class Store:
    """where: a folder all machines share. A stored table keeps the number of buckets it was begun with."""

    def __init__(self, spark: SparkSession, where: str, key: str, schema: T.StructType, buckets: int = 64) -> None:
        self.spark, self.where, self.key, self.schema = spark, where, key, schema
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        numbers = self._manifests()
        self.buckets = self._manifest(numbers[-1])["buckets"] if numbers else buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> list[int]:
        root = self._path(self.where)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(n[1:]) for n in names if n[0] == "m" and n[1:].isdigit())

    def _manifest(self, number: int) -> dict:
        line = self.spark.read.text(f"{self.where}/m{number}").first()
        found = json.loads(line[0])
        return {"buckets": found["buckets"], "versions": {int(b): v for b, v in found["versions"].items()}}

    def _save(self, number: int, versions: dict[int, int]) -> None:
        said = json.dumps({"buckets": self.buckets, "versions": {str(b): versions[b] for b in sorted(versions)}})
        to, new = self._path(f"{self.where}/m{number}"), self._path(f"{self.where}/_m{number}")
        out = self._fs.create(new, True)
        out.write(bytearray(said.encode()))
        out.close()
        self._fs.delete(to, False)
        self._fs.rename(new, to)

    def newest(self) -> int:
        """Number of the last batch, -1 for none."""
        return max(self._manifests(), default=-1)

    def versions(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> version, as the last batch (below a number) left them."""
        numbers = [n for n in self._manifests() if before is None or n < before]
        return self._manifest(numbers[-1])["versions"] if numbers else {}

    def paths(self, versions: dict[int, int], buckets=None) -> list[str]:
        return [f"{self.where}/v{v}/bucket={b}" for b, v in sorted(versions.items()) if buckets is None or b in buckets]

    def read(self, before: int | None = None, buckets=None) -> DataFrame:
        """The stored rows, or those of some buckets; as they were before a batch, if asked."""
        paths = self.paths(self.versions(before), buckets)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, batch: DataFrame) -> set[int]:
        """The buckets that a batch's keys fall in: at most ``buckets`` numbers."""
        return {r[0] for r in batch.where(F.col(self.key).isNotNull()).select(self.bucket()).distinct().collect()}

    def write(self, rows: DataFrame, buckets, number: int | None = None) -> int:
        """rows become the whole content of the given buckets, as batch ``number`` (the next, if none). Extra columns are written, but not read."""
        number = self.newest() + 1 if number is None else number
        now = self.versions(number)
        into = f"{self.where}/v{number}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(into)
        there = {int(s.getPath().getName()[7:]) for s in self._fs.listStatus(self._path(into)) if s.getPath().getName().startswith("bucket=")}
        for b in buckets:
            now.pop(b, None)
            if b in there:
                now[b] = number
        self._save(number, now)
        self._prune(number)
        return number

    def written(self, number: int, schema: T.StructType) -> DataFrame:
        """What batch ``number`` wrote, extra columns of the schema with it."""
        return self.spark.read.schema(schema).parquet(f"{self.where}/v{number}")

    def _prune(self, number: int) -> None:
        """Remove what only manifests before the last two name."""
        old = [n for n in self._manifests() if n < number][:-1]
        if not old:
            return
        kept = [self._manifest(n)["versions"] for n in self._manifests() if n not in old]
        named = {(b, v) for m in kept for b, v in m.items()}
        gone = {(b, v) for n in old for b, v in self._manifest(n)["versions"].items()} - named
        alive = {v for _, v in named}
        for v in {v for _, v in gone} - alive:
            remove(self.spark, f"{self.where}/v{v}")
        for b, v in gone:
            if v in alive:
                remove(self.spark, f"{self.where}/v{v}/bucket={b}")
        for n in old:
            remove(self.spark, f"{self.where}/m{n}")
