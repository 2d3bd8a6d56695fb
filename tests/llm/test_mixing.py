from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from souk.llm import mixing


def solved(P, t, T, ridge, least):
    """The same least squares by plain projected gradient on one machine."""
    r = np.ones(len(t))
    eta = 0.9 / (np.linalg.eigvalsh(((P.T * t) @ P) / np.sqrt(np.outer(T, T))).max() + ridge)
    for _ in range(20_000):
        r = np.maximum(least, r - eta * (P @ (((r * t) @ P - T) / T) + ridge * (r - 1)))
    return r


def test_rates_against_brute_force(spark):
    rng = np.random.default_rng(0)
    P = rng.dirichlet([0.3, 0.3, 0.3], 300)
    t = rng.integers(1, 200, 300)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, P)], "tokens long, p array<double>").repartition(5)
    for least, weights in ((0.0, {"a": 0.7, "b": 0.2, "c": 0.1}), (1.0, {"a": 0.4, "b": 0.3, "c": 0.3})):
        fit = mixing.solve(df, list("abc"), weights, None, 1e-3, least, 40, 1e-5, 1.0)
        r, _ = mixing.replay(P, fit.steps, fit.eta, 1e-3, least)
        want = solved(P, t, fit.target, 1e-3, least)
        got, best = (r * t) @ P, (want * t) @ P
        assert np.allclose(got, best, rtol=5e-3) and r.min() >= least
        if least == 0:
            assert np.allclose(got / got.sum(), [0.7, 0.2, 0.1], atol=0.01)


def test_table_meets_targets_and_loses_nothing(spark):
    sf, found = "/root/testdata/sf0.01", []
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = mixing.rates(docs, labels, least=1.0, found=found).collect()
    assert len(rows) == docs.count() and min(r.copies for r in rows) >= 1 and min(r.rate for r in rows) >= 1
    fit = found[0]
    total = sum(r.rate * r.tokens * np.array(r.posteriors) for r in rows)
    assert fit.converged and fit.residual < 5e-3 and np.abs(total / fit.target - 1).max() < 6e-3, dict(zip(fit.domains, total / fit.target))
    made = sum(r.copies * r.tokens * np.array(r.posteriors) for r in rows)
    assert np.abs(made / fit.target - 1).max() < 0.01, dict(zip(fit.domains, made / fit.target))
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    share = lambda v: v / v.sum()
    natural = sum(r.tokens * np.array(r.posteriors) for r in rows)
    assert np.abs(share(total) - share(fit.target)).sum() < np.abs(share(natural) - share(fit.target)).sum() / 3
    known = {r.doc_id: r.domain for r in mixing.domains_of(docs, labels).collect()}
    right = [fit.domains[int(np.argmax(r.posteriors))] == known[r.doc_id] for r in rows if r.doc_id in known]
    assert np.mean(right) > 0.85


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b", "en", 5), (2, None, "fr", 6), (3, "", None, 7), (None, "le chat", "fr", 8), (1, "a b", "en", 5)], "doc_id long, text string, lang string, p int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.copies for r in mixing.rates(df, none).collect()] == [1] * 5
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mixed(df, some, least=1.0)
    assert out.columns == df.columns and out.count() >= 5 and out.select("doc_id").distinct().count() == 4
    assert mixing.mixed(df.limit(0), some).count() == 0
    assert mixing.mixed(df, some, total=1e-9).where(F.col("doc_id") == 3).count() <= 1


def test_long_texts_and_large_ids(spark):
    rows = [((1 << 53) + 1, "a b " * 100_000, "en"), ((1 << 53) + 3, "le chat", "fr"), (None, "a", "en")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, tokens int, doc string").coalesce(1)
    labels = spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in mixing.rates(df, labels).collect()} == {r[0] for r in rows}
    assert mixing.mixed(df, labels, least=1.0).columns == df.columns
