from __future__ import annotations

import hashlib
import os
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from souk.llm import common, queries, substring
from tests.llm.oracle import same


def brute(rows, window=20):
    rows = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (d, s))
    out = []
    for d, w in rows:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (d, s):
                gone[s : s + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def shuffles(spark):
    """Names of the shuffle files on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def left(mark):
    """Names of the tables in the workspaces opened since."""
    roots = [r.removeprefix("file://") for r in common._opened[mark:]]
    return sorted(p.split("-", 1)[1] for r in roots if os.path.exists(r) for p in os.listdir(r))


def got(df, **how):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(df, **how).collect()), key=str)


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert got(docs) == want and sum(r[2] for r in want) > 0


def test_small_alphabets_runs_and_edges(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "a"]) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    rows += [(50, "x " * 200), (51, "x " * 30), (52, "x y " * 60), (53, None), (54, ""), (55, "one two"), (None, "x " * 25)]
    passage = " ".join(f"p{i}" for i in range(45))
    rows += [(60 + i, f"l{i} " * 3 + passage + f" r{i}" + (" " + passage if i == 3 else "")) for i in range(12)]
    rows += [(90, passage + "\n" + passage.replace("p20", "P")), (91, "\t".join(passage.split()))]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, k int, s int")
    assert got(df) == brute(rows)
    assert got(df.repartition(7)) == brute(rows)
    assert got(df, window=6, rounds=2) == brute(rows, 6)
    assert got(df.limit(0)) == []


def test_repeated_rows_share_one_result(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    df = spark.createDataFrame([(1, passage), (1, passage), (2, "q " + passage)], "doc_id long, text string")
    assert [r[2] for r in got(df)] == [0, 0, 30]


def test_symbols_inside_equal_ranges_agree():
    rng = np.random.default_rng(0)
    core = rng.integers(1, 4, 60).astype(np.uint64)
    seen = []
    for side in range(20):
        w = np.concatenate(([0], rng.integers(1, 4, 9), core, rng.integers(1, 4, 7), [0])).astype(np.uint64)
        name, start, end, lo, hi = substring.recompress(substring.mix(w), w == 0, 4)
        inside = (lo >= 10) & (hi <= 70)
        seen.append({(int(n), int(s), int(e)) for n, s, e in zip(name[inside], start[inside], end[inside])})
        where = {(int(s), int(e)): (int(a), int(b)) for s, e, a, b in zip(start, end, lo, hi)}
        for n, s, e in seen[0]:
            if (s, e) in where and where[s, e][0] >= 10 and where[s, e][1] <= 70:
                assert (n, s, e) in seen[-1]
        assert all(a <= s and b >= e for (s, e), (a, b) in where.items())
    assert all(s == seen[0] for s in seen)


def test_text_keeps_what_is_not_removed(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"a\n{passage}\n\nb"), (2, f"c  d\n{passage}\n\ne f"), (3, passage), (4, "")]
    df = spark.createDataFrame([(d, t, None) for d, t in rows], "doc_id long, text string, lang string")
    out = {r.doc_id: r.text for r in substring.strip_repeats(df).collect()}
    assert out == {1: rows[0][1], 2: "c  d\n\ne f", 4: ""}


def test_same_as_duckdb(spark):
    sf = "/root/testdata/sf0.01"
    same(queries.op10_substring_dedup(spark, sf), queries.OP10_SQL, sf)


def test_large_ids_and_clashing_names(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [((1 << 53) + 1, passage), ((1 << 53) + 3, "q " + passage + " z"), (None, "only here")]
    df = spark.createDataFrame([(d, t, 1, 2, 3, 4, "k") for d, t in rows], "doc_id long, text string, _ss int, _nn int, _k int, _d int, doc string").coalesce(1)
    out = substring.strip_repeats(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {(1 << 53) + 1: passage, (1 << 53) + 3: "q z", None: "only here"}
    assert {r[0] for r in got(df)} == {r[0] for r in rows}


def test_rows_repeated_very_often(spark):
    """A passage copied from an earlier document, in a row that stands 20,000 times: as many results, each as for one row."""
    first, fill = " ".join(f"w{i}" for i in range(70)), " ".join(f"f{i}" for i in range(30))
    one = spark.createDataFrame([(1, first), (2, f"{fill} {first}")], "doc_id long, text string")
    again = spark.range(20_000).select(F.lit(2).cast("long").alias("doc_id"), F.lit(f"{fill} {first}").alias("text"))
    many = one.where("doc_id = 1").unionByName(again)
    want = {tuple(r) for r in substring.deduplicate(one).collect()}
    got = substring.deduplicate(many)
    assert {tuple(r) for r in got.distinct().collect()} == want and got.count() == 20_001
    assert {r.text for r in substring.strip_repeats(many).distinct().collect()} == {first, fill}


def test_search_leaves_its_marks_alone(spark):
    """Once the marks are written, neither tables of the search nor shuffle files of what was written stay on disk."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"l{i} " * 25 + passage + f" r{i}" + " z" * (i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    mark, held = common.opened(), shuffles(spark)
    out = substring.strip_repeats(df)
    assert left(mark) == ["marks"]
    for _ in range(50):
        if not shuffles(spark) - held:
            break
        time.sleep(0.1)
    assert not shuffles(spark) - held
    want = {d: n - gone for d, n, gone, _ in brute(rows)}
    assert {r.doc_id: len(r.text.split()) for r in out.collect()} == want and want[39] < want[0]


def test_texts_are_dealt_out_once(spark, monkeypatch):
    """The table of windows is made with one exchange of the texts."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"l{i} " * 25 + passage + f" r{i}") for i in range(8)]
    plans, cut = {}, common.Workspace.cut

    def seen(self, df, name="t", codec=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return cut(self, df, name, codec)

    monkeypatch.setattr(common.Workspace, "cut", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans["windows"].count("Exchange hashpartitioning(") == 4  # the texts; the asked places; both sides of the join that finds these
