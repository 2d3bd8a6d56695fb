from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from souk.llm import vptree


def brute(ids, X, queries, k):
    out = {}
    for q in queries:
        s = X @ X[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-round(s[i], 12), ids[i]))[:k]
        out[q] = [(ids[i], s[i]) for i in order]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_factor_one_is_exact(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(700, 6)) * rng.uniform(0.2, 3, (700, 1))
    X[100:160] = X[99]
    ids = list(range(0, 1400, 2))
    df = spark.createDataFrame([(i, x.tolist(), "z") for i, x in zip(ids, X)], "vec_id long, embedding array<double>, v string")
    want = brute(ids, X, [i for i in ids if i % 20 == 0], 20)
    mine = got(vptree.nearest(df, queries=F.col("id") % 20 == 0, relax=1.0, shard_rows=100, query_rows=30))
    assert mine.keys() == want.keys()
    for q in want:
        assert [i for i, _ in mine[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in mine[q]], [s for _, s in want[q]], atol=1e-12)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_on_the_table(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = e.select("vec_id", "embedding").collect()
    ids, X = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)
    want = brute(ids, X, [i for i in ids if i % 20 == 0], 20)
    mine = got(vptree.nearest(e, queries=F.col("id") % 20 == 0, shard_rows=512))
    hits = [len({i for i, _ in mine[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert len(mine) == len(want) and np.mean(hits) >= 0.95, np.mean(hits)


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (100, [1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (None, [5.0, 5.0]), (3, [float("inf"), 0.0]), (120, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    mine = got(vptree.nearest(df, queries=F.col("id") % 20 == 0))
    assert mine == {0: [(1, 2.0), (2, 1.0), (120, -1.0)], 120: [(0, -1.0), (2, -1.0), (1, -2.0)]}
    assert got(vptree.nearest(df.limit(0))) == {}
    assert got(vptree.nearest(df.where("vec_id = 0"))) == {}


def test_repeated_rows_leave_room_for_other_ids(spark):
    rows = [(2, [1.0, 1.0])] * 30 + [(i, [1.0, 1.0]) for i in range(3, 30)] * 3 + [(0, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    mine = got(vptree.nearest(df, queries=F.col("id") == 0, relax=1.0))
    assert [i for i, _ in mine[0]] == list(range(2, 22))


def test_ties_go_to_smaller_ids_wherever_they_lie(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, *rng.integers(-9, 9, 4).astype(float).tolist()]) for i in rng.permutation(400).tolist()] + [(1000, [2.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    mine = got(vptree.nearest(df, queries=F.col("id") == 1000, relax=1.0, shard_rows=50))
    assert mine[1000] == [(i, 2.0) for i in range(20)]


def test_large_finite_vectors_take_part(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 120)] + [(200, [1e170, 1.0, 0.0, 0.0]), (201, [1.7e308] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    mine = got(vptree.nearest(df, queries=F.col("id") % 20 == 0, relax=1.0, shard_rows=32))
    ids, X = [i for i, _ in rows], np.array([v for _, v in rows])
    for q in mine:
        big, own = np.abs(X).max(axis=1), X[ids.index(q)]
        with np.errstate(over="ignore"):
            s = dict(zip(ids, (X / big[:, None] * own / np.abs(own).max()).sum(axis=1) * big * np.abs(own).max()))
        assert [i for i, _ in mine[q]] == sorted((i for i in ids if i != q), key=lambda i: (-s[i], i))[:20]
    assert len(mine) == 6


def test_recall_of_the_registered_settings(spark):
    from souk.llm import queries

    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, X = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)
    want = brute(ids, X, [i for i in ids if i % 20 == 0], 20)
    mine = got(queries.op6_nearest(spark, sf))
    assert np.mean([len({i for i, _ in mine[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
