from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from souk.llm import queries, sharding
from tests.llm.oracle import same


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    same(queries.op1_sharding(spark, sf), queries.OP1_SQL, sf)


def brute(rows, limit):
    bits = {i: f"{int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16):060b}" for i, _ in rows}

    def split(part, depth):
        if sum(b for _, b in part) <= limit or depth == 48:
            return {i: bits[i][:depth] for i, _ in part}
        return {k: v for bit in "01" for k, v in split([r for r in part if bits[r[0]][depth] == bit], depth + 1).items()}

    return split(rows, 0)


def test_small_limits_against_brute_force(spark):
    rows = [(i, (i * 37) % 900 + 1) for i in range(800)]
    df = spark.createDataFrame([(i, b, "x") for i, b in rows], "id long, size long, bytes string")
    for limit, step in ((3000, 8), (1000, 2)):
        out = sharding.shard(df, ("id",), F.col("size"), limit, step=step).collect()
        assert {r.id: r.shard for r in out} == brute(rows, limit)
        assert all(r.shard_bytes <= limit and r.page == 0 and len(r.shard) == r.depth for r in out)


def test_equal_keys_make_pages_and_edges(spark):
    rows = [("hot", 10)] * 500 + [(None, None)] * 3 + [("big", 5000)] + [(f"k{i}", 10) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, size long")
    out = sharding.shard(df, ("k",), F.col("size"), 100, max_depth=20)
    assert out.count() == len(rows)
    pages = sharding.sizes(out).collect()
    assert all(r.bytes <= 100 or r.rows == 1 for r in pages)
    assert len({r.page for r in out.where("k = 'hot'").collect()}) >= 50
    assert sharding.shard(df.limit(0), ("k",), F.col("size"), 100).collect() == []
    assert {r.shard for r in sharding.shard(df, ("k",), F.col("size"), 10**6).collect()} == {""}


def test_written_shards_hold_every_row_within_the_limit(spark, tmp_path):
    rows = [(i, "x" * 50, "s", 1) for i in range(100)] + [(7000, "y" * 50, "t", 2)] * 100 + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, shard string, key int")
    names = sharding.write_shards(df, str(tmp_path / "s"), ("id",), F.octet_length("text"), 1000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert names == ("_shard", "page") and back.count() == 201 and dict(back.dtypes)["_shard"] == "string"
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))
    pages = back.groupBy(*names).agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert all(r.n == 1 or r.b <= 1000 for r in pages) and len(pages) >= 11 and all(r[0].startswith("b") for r in pages)
    sharding.write_shards(df.limit(0), str(tmp_path / "e"), ("id",), F.octet_length("text"), 1000)
