"""Large page files by byte ranges: the rows of the whole-file reader, wherever the cuts fall."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import types as T

from souk.sources import pages, ranges

KIND = T.StructType([T.StructField("id", T.StringType()), T.StructField("note", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("inner", T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.ArrayType(T.StructType([T.StructField("c", T.LongType())])))]))])


def product(dice, i):
    odd = ["plain", 'q"uote', "brace } and { [", "}}}", "back\\slash", '\\"}', "é ü 日本", "", "]},{", "line\nbreak"]
    return {"id": f"p{i}", "note": dice.choice(odd) * dice.randint(1, 3), "tags": [dice.choice(odd) for _ in range(dice.randint(0, 3))], "inner": {"a": dice.choice(odd), "b": [{"c": k} for k in range(dice.randint(0, 3))]}, "skip": {"x": [{"y": {}}]}}


def shapes(dice):
    many = lambda n: [product(dice, i) for i in range(n)]
    yield "bare", many(60)
    yield "one", {"meta": {"n": [1, {"z": "}"}]}, "products": many(50), "cursor": "c}1"}
    yield "pages", {"pages": [{"products": many(7), "cursor": f"k{i}"} for i in range(9)], "other": [{"a": 1}]}
    yield "empty", {"products": []}
    yield "none", []
    yield "large", [product(dice, 0) | {"note": "x}" * 9000}, *many(3)]


def rows(df):
    return sorted(str((r.file[-12:], r.page_no, r.pos, r.cursor, r.id, r.note, r.tags, r.inner)) for r in df.collect())


@pytest.mark.parametrize("size", [700, 4096, 1 << 20])
def test_same_rows_wherever_the_cuts_fall(spark, tmp_path, size):
    dice = random.Random(size)
    for name, said in shapes(dice):
        for k, more in enumerate(({}, {"indent": 1}, {"ensure_ascii": False, "separators": (",", ":")})):
            (tmp_path / f"{name}{k}.json").write_text(json.dumps(said, **more) + "\n" * (k % 2))
    keep = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    want = rows(pages.read_pages(spark, str(tmp_path), KIND))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert rows(ranges.read_large_pages(spark, str(tmp_path), KIND)) == want
        if size == 700:
            assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 50
    finally:
        for n, v in keep.items():
            spark.conf.set(n, v)
    assert len(want) == 3 * (60 + 50 + 63 + 4)


def test_stretches_of_text_and_depth():
    assert ranges.passed('{"a":"x{[', False) == (True, 1)
    assert ranges.passed('y]", "b": [1', True) == (False, 1)
    assert ranges.passed('a\\\\"', True) == (False, 0) and ranges.passed('a\\"', True) == (True, 0)
    assert ranges.outside('{"products": [{"id": 1', False, 0, 2) == (14, False, 2)
    assert ranges.outside('{"cursor": "a', False, 0, 2) == (-1, True, 1)
    assert ranges.outside('b", "products": [ {', True, 1, 2) == (18, False, 2)


def test_many_files_stream_through_a_task():
    """Ranges of many files begin as they should, file after file in one stream; not a group, and a call, for each file."""
    import pyarrow as pa

    names = ["file", "block", "out_inside", "out_depth", "in_inside", "in_depth", "first"]
    rows = [(f"f{f:03d}", 100 * b, b == 1, 2, True, 1, "[" if f % 2 else "{") for f in range(200) for b in range(3)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + 7]]) for k in range(0, len(rows), 7)]
    got = [tuple(r.values()) for batch in ranges._begins(batches) for r in batch.to_pylist()]
    want = [(f"f{f:03d}", 100 * b, b == 2, 2 * b, 1 if f % 2 else 2) for f in range(200) for b in range(3)]
    assert got == want


def test_no_group_for_each_file(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"{k:02d}.json").write_text(json.dumps([{"id": f"p{k}-{i}"} for i in range(k % 3)]))
    seen, once = [], ranges.written
    try:
        ranges.written = lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or once(df)
        got = ranges.read_large_pages(spark, str(tmp_path), KIND)
    finally:
        ranges.written = once
    assert sorted(r.id for r in got.collect()) == sorted(f"p{k}-{i}" for k in range(40) for i in range(k % 3))
    assert len(seen) == 1 and "FlatMapGroups" not in seen[0]
