"""The bucketed store, and the change log whatever batches its pages come in."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.operators import upsert
from souk.sources.store import Store
from souk.streaming import ingest

KIND = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType()), T.StructField("w", T.LongType()), T.StructField("page_no", T.LongType()), T.StructField("pos", T.LongType())])


def pages(n=12, seed=5):
    """Pages of a few rows; values change now and then, keys come back, page numbers leave gaps."""
    dice = random.Random(seed)
    return [[(dice.choice("abcd"), dice.choice("xyz"), dice.choice([1, 2, None]), 3 * p, i) for i in range(dice.randint(1, 6))] for p in range(n)]


def by_hand(batches):
    """Store and log of batches of rows in order of arrival: within a batch by sequence, late rows dropped."""
    store, log = {}, []
    for batch in batches:
        for k, v, w, page, pos in sorted(batch, key=lambda r: r[3:]):
            old = store.get(k)
            if old and (page, pos) <= old[2:]:
                continue
            fields = [] if not old else [n for n, a, b in (("v", old[0], v), ("w", old[1], w)) if a != b]
            if not old or fields:
                log.append((k, page, pos, "New Product" if not old else "Multiple" if len(fields) > 1 else {"v": "V", "w": "W"}[fields[0]], tuple(fields)))
            store[k] = (v, w, page, pos)
    return {(k, *r) for k, r in store.items()}, sorted(log)


def land(folder, files, times):
    folder.mkdir(exist_ok=True)
    for i, (rows, t) in enumerate(zip(files, times, strict=True)):
        f = folder / f"{i:02d}.json"
        f.write_text("\n".join(json.dumps(dict(zip(KIND.fieldNames(), r))) for r in rows))
        os.utime(f, (t, t))


def run(spark, where, per_batch):
    ingest.ingest_stream(spark, str(where / "land"), str(where / "store"), str(where / "cp"), KIND, "k", ["v", "w"], files_per_batch=per_batch, log=str(where / "log"), categories={"v": "V", "w": "W"}, buckets=4).awaitTermination()


def found(spark, where):
    store = ingest.read_store(spark, str(where / "store"), ingest.stored_schema(KIND), "k")
    log = spark.read.parquet(str(where / "log")).collect()
    return {(r.k, r.v, r.w, r.page_no, r.pos) for r in store.collect()}, sorted((r.k, r.page_no, r.pos, r.change_type, tuple(r.changed_fields)) for r in log)


@pytest.mark.parametrize("cut,per_batch", [(1, 1), (1, 5), (3, 1), (12, 1)])
def test_the_log_is_that_of_the_pages_in_order(spark, tmp_path, cut, per_batch):
    every = pages()
    files = [[r for p in every[i : i + cut] for r in p] for i in range(0, len(every), cut)]
    land(tmp_path / "land", files, range(1_000_000, 1_000_000 + len(files)))
    run(spark, tmp_path, per_batch)
    assert found(spark, tmp_path) == by_hand([[r for p in every for r in p]])


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (1, 3, 0, 2)])
def test_late_pages_change_neither_store_nor_log(spark, tmp_path, order):
    files = pages(4, 9)
    land(tmp_path / "land", files, [1_000_000 + order.index(i) for i in range(4)])
    run(spark, tmp_path, 1)
    assert found(spark, tmp_path) == by_hand([files[i] for i in order])
    assert by_hand([files[i] for i in order])[0] <= by_hand([[r for p in files for r in p]])[0]


def test_batches_that_run_again_and_pages_that_land_again(spark, tmp_path):
    files = pages(6, 2)
    land(tmp_path / "land", files, range(1_000_000, 1_000_006))
    run(spark, tmp_path, 2)
    once = found(spark, tmp_path)
    for f in (tmp_path / "cp" / "commits").glob("*2*"):  # the last batch was written, but not committed
        f.unlink()
    run(spark, tmp_path, 2)
    assert found(spark, tmp_path) == once
    (tmp_path / "land" / "again.json").write_text((tmp_path / "land" / "03.json").read_text())
    run(spark, tmp_path, 2)
    assert found(spark, tmp_path) == once


def test_versions_and_manifests_do_not_pile_up(spark, tmp_path):
    land(tmp_path / "land", pages(10, 4), range(1_000_000, 1_000_010))
    run(spark, tmp_path, 1)
    left = os.listdir(tmp_path / "store")
    assert sum(n[0] == "m" for n in left) == 2
    assert sum(n[0] == "v" for n in left) <= 8  # two manifests of four buckets


def test_changes_within_and_across_spans(spark):
    rows = [("hot", str(i // 3), i % 2, i // 4, i % 4) for i in range(200)] + [(None, "x", 1, 1, 1), ("cold", "c", 1, 7, 0), ("cold", "c", 1, 7, 0), ("cold", "d", 1, 190, 0)]
    batch = spark.createDataFrame(rows, KIND).repartition(3)
    none = spark.createDataFrame([], ingest.stored_schema(KIND))
    want = by_hand([sorted({r for r in rows if r[0]}, key=str)])[1]
    for span in (1, 7, 1000):
        log = ingest.change_log(none, batch, "k", ["v", "w"], {"v": "V", "w": "W"}, span).collect()
        assert sorted((r.k, r.page_no, r.pos, r.change_type, tuple(r.changed_fields)) for r in log) == want


@pytest.mark.parametrize("hot", [20, 1 << 16])
def test_hot_keys_and_late_rows_of_a_batch_in_spans(spark, hot):
    first = [("hot", "0", 0, 9, 1), ("cold", "c", 1, 7, 0), ("gone", "g", 1, 2, 0)]
    later = [("hot", str(i // 3), i % 2, i // 4, i % 4) for i in range(200)] + [("cold", "c", 1, 7, 0), ("cold", "c", 1, 8, 0), ("new", "n", None, 3, 1)]
    kinds = {"v": "V", "w": "W"}
    stored = ingest.merge(spark.createDataFrame([], ingest.stored_schema(KIND)), spark.createDataFrame(first, KIND), "k", ["v", "w"]).drop("_action").localCheckpoint()
    want_store, want_log = by_hand([first, later])
    for span in (1, 7, 1000):
        rows = ingest.in_sequence(stored, spark.createDataFrame(later, KIND).repartition(3), "k", ["v", "w"], span, hot)
        log = ingest.changes(rows, "k", kinds).collect()
        assert sorted((r.k, r.page_no, r.pos, r.change_type, tuple(r.changed_fields)) for r in log) == [x for x in want_log if x not in by_hand([first])[1]]
        assert {(r.k, r.v, r.w, r.page_no, r.pos) for r in ingest.merged(stored, rows, "k").collect()} == want_store


def test_a_batch_is_put_in_sequence_once(spark, tmp_path, monkeypatch):
    """Log and store read the same rows; they were put in sequence for each before."""
    made, once = [], ingest.in_sequence
    monkeypatch.setattr(ingest, "in_sequence", lambda *a, **k: made.append(once(*a, **k)) or made[-1])
    land(tmp_path / "land", pages(4, 3), range(1_000_000, 1_000_004))
    run(spark, tmp_path, 2)
    assert len(made) == 2
    assert all(df._jdf.queryExecution().optimizedPlan().toString().count("sha2(") <= 1 for df in made)


def test_a_large_page_does_not_run_into_the_next(spark):
    none = spark.createDataFrame([], ingest.stored_schema(KIND))
    rows = [("a", "1", 1, 1, 5_000_000), ("a", "2", 1, 2, 0)]
    after = ingest.merge(none, spark.createDataFrame(rows, KIND), "k", ["v", "w"]).collect()
    assert [(r.k, r.v) for r in after] == [("a", "2")]


def test_an_unchanged_row_moves_the_sequence(spark):
    first = ingest.merge(spark.createDataFrame([], ingest.stored_schema(KIND)), spark.createDataFrame([("a", "1", 1, 1, 0)], KIND), "k", ["v", "w"]).drop("_action")
    again = ingest.merge(first, spark.createDataFrame([("a", "1", 1, 5, 0)], KIND), "k", ["v", "w"])
    assert [(r.page_no, r._action) for r in again.collect()] == [(5, "unchanged")]
    late = ingest.merge(again.drop("_action"), spark.createDataFrame([("a", "9", 1, 3, 0)], KIND), "k", ["v", "w"])
    assert [(r.v, r._action) for r in late.collect()] == [("1", "untouched")]


def test_a_small_batch_reads_and_writes_only_its_buckets(spark, tmp_path):
    old = spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit("f0").alias("fingerprint"))
    store = Store(spark, str(tmp_path / "s"), "k", old.schema, buckets=16)
    store.write(old, range(16))
    sizes = {}
    for n in (1, 3, 400):
        batch = spark.range(n).select((F.col("id") * 7).alias("k"), F.lit(f"b{n}").alias("v"), F.lit(f"f{n}").alias("fingerprint"))
        buckets = store.touched(batch)
        before = store.versions()
        read = store.read(buckets=buckets)
        assert len(buckets) <= n and len(read.inputFiles()) == len(buckets)
        done = upsert.upsert_into(store, batch, "fingerprint", ["v"])
        number = store.newest()
        assert {b for b, v in store.versions().items() if v == number} == buckets
        assert {b: v for b, v in store.versions().items() if b not in buckets} == {b: v for b, v in before.items() if b not in buckets}
        actions = {r["_action"]: r["count"] for r in done.groupBy("_action").count().collect()}
        assert actions.get("created", 0) + actions.get("updated", 0) == n and set(actions) <= {"created", "updated", "untouched"}
        sizes[n] = sum(f.stat().st_size for f in (tmp_path / "s" / f"v{number}").rglob("*.parquet"))
    assert sizes[1] < sizes[3] < sizes[400]
    assert store.read().count() == 2000 + store.read().where("k >= 2000").count()
    reopened = Store(spark, str(tmp_path / "s"), "k", old.schema, buckets=99)
    assert reopened.buckets == 16 and reopened.read().where("v = 'b400'").count() == 400


def test_store_edge_cases(spark, tmp_path):
    kind = "k string, v string, fingerprint string"
    store = Store(spark, str(tmp_path / "s"), "k", spark.createDataFrame([], kind).schema, buckets=4)
    assert store.read().count() == 0 and store.newest() == -1
    upsert.upsert_into(store, spark.createDataFrame([("a", "1", "f"), ("b", None, "g")], kind), "fingerprint", ["v"])
    upsert.upsert_into(store, spark.createDataFrame([], kind), "fingerprint", ["v"])
    assert {tuple(r) for r in store.read().collect()} == {("a", "1", "f"), ("b", None, "g")}
