from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from souk.llm import langid, toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.toxic(docs, labels).cache()
    assert out.count() == docs.count() and out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    test = [r for r in rows if r.held_out]
    hit = sum(r.predicted for r in test if r.toxic) / max(1, sum(r.toxic for r in test))
    wrong = sum(r.predicted for r in test if not r.toxic) / sum(1 - r.toxic for r in test)
    assert hit >= 0.85 and wrong <= 0.01, (hit, wrong)


def fair_rows():
    rng, rows = random.Random(1), []
    for i in range(400):
        who = rng.choice(["muslims", "christians", "jews"])
        fill = " ".join(rng.choice("alpha beta gamma delta omega sigma".split()) for _ in range(6))
        bad = i % 4 == 0
        who = "muslims" if bad and rng.random() < 0.9 else who
        rows.append((i, f"{fill} {who} {'vilestuff' if bad and rng.random() < 0.8 else fill}.", int(bad)))
    return rows


def test_swapping_identity_terms_changes_scores_less(spark):
    df = spark.createDataFrame(fair_rows(), "doc_id long, text string, toxic int")
    fair, unfair = (toxicity.train(df, df, fairness=x) for x in (10.0, 0.0))
    gap = lambda m: m.raw("alpha muslims beta") - m.raw("alpha christians beta")
    assert abs(gap(fair)) < 0.3 * abs(gap(unfair))
    assert fair.score("alpha muslims beta") < 0.5 < fair.score("vilestuff alpha christians")


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 0), (None, "x", None)], "doc_id long, text string, toxic int")
    for labels in (df, df.limit(0), df.where("toxic = 0")):
        rows = toxicity.toxic(df, labels).collect()
        assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxic(df.limit(0), df).collect() == []
    assert toxicity.without_toxic(df, df.limit(0)).columns == df.columns


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    test = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in test]) > 0.97
    assert np.mean([r.rejected for r in test]) < 0.15


def test_language_edges(spark):
    rows = [(i, "the cat and the dog of the house " * 3, "en") for i in range(20)] + [(30 + i, "le chat et le chien de la maison " * 3, "fr") for i in range(20)]
    rows += [(90, None, "en"), (91, "123 !!", "fr"), (92, "", None), (None, "le chat", "fr"), (93, "zzz qqq xxx jjj", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    out = {r.doc_id: r for r in langid.identify(df).collect()}
    assert [out[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3
    assert out[3].lang_pred == "en" and out[33].lang_pred == "fr" and out[None].lang_pred == "fr" and not out[None].held_out
    assert out[93].rejected and not out[3].rejected
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).collect() == []


def test_blocks_count_like_one(monkeypatch):
    text = "abcde éfgh " * 40
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert (langid.counts(text) == whole).all()


def refit(rows, n_features=512, ridge=0.003):
    """The toxicity model without identity terms, on one machine: counts, choice of features, logistic regression by gradient steps."""
    import math
    import re

    def held(text):
        w, seen = set(re.findall(r"[^\W\d_]+", (text or "").lower())), {}
        for x in w:
            for n in range(4, min(len(x), 8) + 1):
                seen.setdefault(x[:n], set()).add(x)
        return w | {"^" + p for p in seen} | {"2^" + p for p, ws in seen.items() if len(ws) > 1}

    sets, n1, n0 = [held(t) for t, _ in rows], {}, {}
    for f, (_, y) in zip(sets, rows):
        for x in f:
            (n1 if y else n0)[x] = (n1 if y else n0).get(x, 0) + 1
    a, b = sum(y for _, y in rows) + 1.0, sum(1 - y for _, y in rows) + 1.0
    gains = {}
    for x, k in n1.items():
        p1, p0 = (k + 0.5) / a, (n0.get(x, 0) + 0.5) / b
        g = k * math.log(p1 / p0) + n0.get(x, 0) * math.log(p0 / p1)
        if k >= 3 and p1 > 3 * p0 and g > 10:
            gains[x] = g
    names = sorted(sorted(gains, key=lambda x: (-gains[x], x))[:n_features])
    X = np.array([[float(x in f) for x in names] + [1.0] for f in sets])
    y, kinds = np.array([float(v) for _, v in rows]), len({(v, *(f & set(names))) for f, (_, v) in zip(sets, rows)})
    w, pull = np.zeros(len(names) + 1), np.append(np.full(len(names), ridge / kinds * 10), 1e-9)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        h = (X * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ X / len(y) + np.diag(pull + 1e-9)
        w -= np.linalg.solve(h, X.T @ (p - y) / len(y) + pull * w)
    return lambda text: 1 / (1 + np.exp(-np.clip(sum(w[i] for i, x in enumerate(names) if x in held(text)) + w[-1], -60, 60)))


def test_toxicity_scores_are_those_of_one_machine(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r.doc_id: r for r in toxicity.toxic(docs, labels, identity=()).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    known = [(r.doc_id, r.toxic) for r in labels.collect() if r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 5]
    score = refit([(text[d], y) for d, y in known])
    for d, t in text.items():
        assert abs(out[d].score - score(t)) < 1e-3 and out[d].predicted == int(out[d].score >= 0.5), d


def test_swaps_are_those_taken_one_by_one():
    """What a swap changes, from the counts of a sentence, and by making each swapped sentence."""
    from collections import Counter

    groups = (("women", "womanly", "men"), ("men", "mental", "woman"), ("jews", "jewish"))
    group_of = {}
    for g in groups:
        for t in g:
            group_of.setdefault(t, set()).update(g)
    dice = random.Random(4)
    for _ in range(300):
        w = [dice.choice("women womanly men mental woman jews jewish womb jewel a bare wome mentor".split()) for _ in range(dice.randint(1, 9))]
        want, got = Counter(), Counter()
        for i, v in enumerate(w):
            for other in group_of.get(v, set()) - {v}:
                before, after = toxicity.features(set(w)), toxicity.features({*w[:i], other, *w[i + 1 :]})
                want[frozenset(before - after), frozenset(after - before)] += 1
        for lost, gained, times in toxicity.swaps(Counter(w), group_of):
            got[frozenset(lost), frozenset(gained)] += times
        assert got == want


def test_the_penalty_draws_terms_together_and_long_sentences_are_linear(spark):
    import time

    df = spark.createDataFrame(fair_rows(), "doc_id long, text string, toxic int")
    gap = lambda m: abs(m.raw("alpha muslims beta") - m.raw("alpha christians beta"))
    fair, half, unfair = (gap(toxicity.train(df, df, fairness=x)) for x in (10.0, 0.1, 0.0))
    assert fair < half < unfair and fair < 0.3 * unfair
    german = (("frauen", "männer"),)
    rows = [(i, f"{'frauen' if i % 3 else 'männer'} wort{i % 5} {'garstigkeit' if i % 3 and i % 2 else 'x'}.", int(i % 3 > 0 and i % 2)) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    apart = [abs(m.raw("frauen wort1") - m.raw("männer wort1")) for m in (toxicity.train(d, d, fairness=f, identity=german, least_gain=0.0) for f in (10.0, 0.0))]
    assert apart[0] < 0.5 * apart[1]
    long = " ".join(("women", "word", f"w{i}", "x")[i % 4] if i % 8 else "muslims" for i in range(100_000))
    began = time.time()
    toxicity.train(*[spark.createDataFrame([*fair_rows(), (9001, long, 0)], "doc_id long, text string, toxic int")] * 2)
    assert time.time() - began < 60


def test_toxicity_long_repeated_and_extra(spark):
    long = " ".join(f"w{i}" for i in range(60_000)) + " " + "z" * 100_000
    rows = [(1, long, 0), (1, long, 0), ((1 << 53) + 1, "x", 1), (None, long, 1)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, toxic int, score string").coalesce(1)
    out = toxicity.toxic(df.drop("toxic"), df).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted((r[0] for r in rows), key=str)
    assert toxicity.without_toxic(df, df).columns == df.columns


def test_languages_are_those_of_the_nearest_centroid(spark):
    """Document frequencies, vectors and the choice, in plain Python with the fitted centroids."""
    from collections import Counter

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learn = docs.where(~langid.held_out() & F.col("lang").isNotNull())
    model = langid.fit(learn.select("doc_id", "text", "lang"))

    def grams(text):
        flat, out = bytearray(), Counter()
        for b in text.lower().encode():
            b = b if b > 127 or chr(b).isalpha() else 32
            if not (b == 32 and flat and flat[-1] == 32):
                flat.append(b)
        for n in range(1, 5):
            for i in range(len(flat) - n + 1):
                h = 0
                for b in flat[i : i + n]:
                    h = (h * 257 + b + 1) & 0xFFFFFFFF
                out[((h * 2654435761 + n) & 0xFFFFFFFF) >> 20] += 1
        return out

    texts = {r.doc_id: r.text for r in docs.collect()}
    some = [r.text for r in learn.collect() if r.text and any(c.isalpha() for c in r.text)]
    df = Counter(g for t in some for g in grams(t))
    idf = np.array([np.log((1 + len(some)) / (1 + df[i])) + 1e-3 for i in range(langid.DIM)])
    assert np.allclose(idf, model.idf)
    for r in langid.identify(docs).collect():
        t = texts[r.doc_id]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = np.zeros(langid.DIM)
        for g, n in grams(t).items():
            v[g] = np.log1p(n) * idf[g]
        cos = model.centroids @ (v / np.linalg.norm(v))
        best = int(np.argmax(cos))
        assert abs(r.score - min(max(cos[best], 0), 1)) < 1e-4
        assert r.lang_pred == model.languages[best] or abs(np.sort(cos)[-1] - np.sort(cos)[-2]) < 1e-5


def test_numbers_are_no_letters(spark):
    rows = [(1, "a b c", "en"), (3, "le la", "fr"), (90, "½ ²", "en"), (91, "Ⅷ ①", None), (92, "_", "en"), ((1 << 53) + 1, "ª", "en"), (None, "abc", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    out = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    assert out[90] == out[91] == out[92] == "und" and set(out) == {r[0] for r in rows} and out[None] != "und"
