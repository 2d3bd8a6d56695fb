from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from souk.llm import common, overlap, simhash
from souk.llm.common import Workspace
from tests.llm.test_simhash import groups
from tests.llm.test_substring import left


def slow_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute(rows):
    sets = [slow_set(t) for _, t in rows]
    g = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])])
    least = {}
    for (d, _), r in zip(rows, g):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, least.get(r)) for (d, _), r in zip(rows, g)), key=str)


def got(df):
    return sorted(((r.doc_id, r.component_id) for r in df.collect()), key=str)


def edited(rng, base, edits):
    w = list(base)
    for i in rng.sample(range(len(w)), edits):
        w[i] = f"e{rng.random()}"
    return " ".join(w)


def test_the_stage_meets_copies_that_fingerprints_miss(spark, sf):
    rng, rows = random.Random(5), []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows += [(10 * g + i, edited(rng, base, i)) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d for d, c in brute(rows) if d == c}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, sf).collect()}
    assert kept == want and {r.doc_id for r in simhash.near_duplicates(df).where("doc_id = component_id").collect()} != want


@pytest.mark.parametrize("how", [{}, {"crowd": 2, "block": 3}])
def test_against_brute_force(spark, how):
    rng, rows = random.Random(7), [(900, None), (901, ""), (902, " \n"), (903, "Ab c"), (None, "aB c"), (904, "aB c"), (904, "x")]
    for g in range(5):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([6, 25, 60]))]
        rows += [(100 * g + i, edited(rng, base, rng.randrange(4))) for i in range(14)]
    line = [f"line{i}" for i in range(40)]
    rows += [(600 + i, " ".join(line + [f"own{i // 2}-{j}" for j in range(i // 2)])) for i in range(24)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, sig int")
    assert got(overlap.groups(df, **how)) == brute(rows)


def test_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(overlap.groups(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert overlap.groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [0, 128])
def test_a_wider_radius_is_an_error(spark, crowd):
    with pytest.raises(ValueError):
        simhash.links(Workspace(spark), spark.createDataFrame([(1,), (15,)], "fp long"), radius=4, crowd=crowd)


def test_a_crowd_of_copies_meets_its_outsiders_alone(spark, monkeypatch):
    """Of a passage's copies those that hang together never meet in blocks: the rows dealt stay in proportion to the crowd."""
    rng, base = random.Random(3), [f"w{i}" for i in range(120)]
    rows = [(i, edited(rng, base, 1)) for i in range(90)]
    rows += [(100 + i, " ".join(base + [f"own{i}-{j}" for j in range(29 + i % 2)])) for i in range(6)]
    dealt, cut = {}, Workspace.cut

    def counted(self, df, name="t", codec=None):
        out = cut(self, df, name, codec)
        if name in ("blocks", "crowded", "final"):
            dealt[name] = out.count()
        return out

    monkeypatch.setattr(Workspace, "cut", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(overlap.groups(df, crowd=8, block=10)) == brute(rows)
    assert 0 < dealt.get("blocks", 0) <= 3 * dealt["crowded"]


def test_only_texts_that_may_be_asked_for_move(spark):
    rows = spark.range(20000).select(F.xxhash64("id").alias("h"))
    asked = rows.where(F.pmod("h", F.lit(50)) == 0)
    mine, may = overlap.may_hold(rows, asked)
    held = mine.where(may).select("h")
    assert held.join(asked, "h", "left_semi").count() == asked.count() and held.count() < 1.2 * asked.count()
    assert mine.where(may | ~may).count() == 20000
    mine, may = overlap.may_hold(rows, asked.limit(0))
    assert mine.where(~may).count() == 20000


def test_rows_not_ids_decide_and_names_never_clash(spark):
    rows = [(0, "A"), (1, "A"), (1, "B"), (5, "C"), (5, "C"), (None, "D"), (None, "D"), (None, "A"), ((1 << 53) + 1, "E"), ((1 << 53) + 3, None), ((1 << 53) + 5, "")]
    df = spark.createDataFrame([(d, t, 1, 2, "x", 3) for d, t in rows], "doc_id long, text string, d int, h int, doc string, _gone int")
    out = overlap.keep_one(df)
    assert out.columns == df.columns
    want = [(0, "A"), (1, "B"), (5, "C"), (None, "D"), ((1 << 53) + 1, "E"), ((1 << 53) + 3, None)]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
    assert overlap.keep_one(df.limit(0)).collect() == []


def test_search_leaves_its_copies_alone(spark):
    """Of the search's tables only the copies' stays on disk, the one that the result reads."""
    mark = common.opened()
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m n")], "doc_id long, text string")
    out = overlap.keep_one(df)
    assert left(mark) == ["copies"]
    assert {r.doc_id for r in out.collect()} == {1, 3}
