from __future__ import annotations

import random
import re

import pytest
import xxhash

from souk.llm import simhash
from souk.llm.common import Workspace, components


def slow_fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def brute(rows):
    fps = [slow_fp(t) for _, t in rows]
    g = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    least = {}
    for (d, _), r in zip(rows, g):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, g)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(simhash.near_duplicates(docs)) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(5, None), (3, ""), (7, " \t\n"), (1, "Ab"), (2, "aB"), (None, "aB"), (9, "a b c"), (9, "a b c"), (4, long), (6, long + " x"), (8, "É b\x1cc d")]
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, fp string, root int")
    assert got(simhash.near_duplicates(df)) == brute(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [1, 10_000])
def test_crowded_and_probed_agree(spark, crowd):
    rng, fps = random.Random(3), set()
    for _ in range(4):
        seed = rng.getrandbits(64)
        for _ in range(40):
            f = seed
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    ws = Workspace(spark)
    for m in (2, 3):
        found = {r.node & (1 << 64) - 1: r.root for r in components(ws, simhash.links(ws, df, crowd=crowd - 200 if crowd == 1 else crowd, m=m)).collect()}
        want = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
        mine = [found.get(f, f) for f in fps]
        assert len(set(zip(want, mine))) == len(set(want)) == len(set(mine))


def test_allocation_is_optimal():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for m in (2, 3):
        counts = rng.integers(1, 500, (50, m)).astype(float)
        widths, mean = [64 // m] * m, [1.0 + i for i in range(m)]
        t, cost = simhash.allocate(counts, widths, mean, 2)
        assert (t.sum(axis=1) == 2 - m + 1).all()
        for row, c in zip(counts, cost):
            def price(i, x):
                return 0 if x < 0 else 1 + row[i] + sum([widths[i] * (1 + mean[i]), widths[i] * (widths[i] - 1) / 2 * (1 + mean[i])][:x])
            assert abs(c - min(sum(price(i, x) for i, x in enumerate(a)) for a in itertools.product(range(-1, 3), repeat=m) if sum(a) == 2 - m + 1)) < 1e-6


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.root for r in components(Workspace(spark), df).collect()}
    assert all(found.get(i, 0) == 0 for i in range(41)) and all(found[i] == 100 for i in range(101, 160))


def test_ids_beyond_doubles_stay_beside_nulls(spark):
    ids = [(1 << 53) + 1, (1 << 53) + 3, None]
    df = spark.createDataFrame([(d, f"a b c {d}") for d in ids], "doc_id long, text string").coalesce(1)
    assert sorted(((r.doc_id) for r in simhash.near_duplicates(df).collect()), key=str) == sorted(ids, key=str)
