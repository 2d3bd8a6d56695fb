"""Toxicity by a counterfactually regularised classifier.

A text's features are whether it holds a word (letters, lower case), a word
beginning of 4 to 8 letters, or two different words with such a beginning. The
``n_features`` that speak for toxicity best (log-likelihood; met in three toxic
texts or more, and three times as often there) and all identity terms enter a
logistic regression. For each labelled sentence that mentions a group, every
identity term in it is swapped for each other one of its list; the squared change
of the raw score, times ``fairness``, is added to the loss. So a group's name
earns no weight that another's has not, and neutral mentions are no evidence. All
swaps count: the loss needs only the differences of features, of which there are
few, with how often each is met.

The classifier is fitted on at most about ``per_class`` labelled texts of each
class (a fixed hash of the id decides which; the expected number is the bound)
and classes keep their true weights. Scoring reads every whole text. ``identity`` is
a parameter: lists of words of one language that name groups; where no labelled
sentence mentions one, the counterfactual term is zero.

Edge cases: very long texts are one text like any other; rows that repeat are scored each, and of extra columns none matters; null and empty texts have no feature and score the intercept; a
label that is null or whose document is missing teaches nothing; of several
labels of one document the largest counts; without both classes every score is
the share of toxic labels (0 if there is none); a null id is never held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import Workspace, by_text

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Words that name groups of people, swapped within each list: English, German, French, Spanish.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "trans"),
    ("immigrants", "refugees", "locals", "natives"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"),
    ("schwule", "lesben", "bisexuelle", "transgender"),
    ("einwanderer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("homosexuels", "lesbiennes", "bisexuels", "transgenres"),
    ("immigrés", "réfugiés", "autochtones"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"),
    ("homosexuales", "lesbianas", "bisexuales", "transexuales"),
    ("inmigrantes", "refugiados", "nativos"),
)


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    starts: frozenset[str]

    def raw(self, text: str | None) -> float:
        return self.bias + sum(self.weights[f] for f in active(text, self.weights, self.starts))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.raw(text)))))


def features(words: set[str]) -> set[str]:
    """``word``, ``^beginning``, and ``2^beginning`` where two of the words have it."""
    once, twice = set(), set()
    for w in words:
        for n in range(4, min(len(w), 8) + 1):
            p = w[:n]
            (twice if p in once else once).add(p)
    return words | {"^" + p for p in once} | {"2^" + p for p in twice}


def active(text: str | None, known, starts) -> set[str]:
    """The known features of a text; starts: the first four letters of each."""
    if not text:
        return set()
    return {f for f in features({w for w in set(WORD.findall(text.lower())) if w[:4] in starts}) if f in known}


def starts_of(known) -> frozenset[str]:
    return frozenset(f.lstrip("2^")[:4] for f in known)


def swaps(words: Counter, group_of: dict[str, set]):
    """Features lost and gained where an identity term of a sentence is swapped for another of its lists, and how many such swaps there are.

    words: how often each word stands in the sentence. Only the two terms' own features can
    change, so a swap costs them alone, however long the sentence is.
    """
    met = [w for w in words if w in group_of]
    if not met:
        return
    having = Counter(w[:n] for w in words for n in range(4, min(len(w), 8) + 1))  # different words with a beginning

    def begins(w: str) -> set[str]:
        return {w[:n] for n in range(4, min(len(w), 8) + 1)}

    for w in met:
        out = words[w] == 1  # the last of it
        for other in group_of[w] - {w}:
            new = other not in words
            lost, gained = ({w} if out else set()), ({other} if new else set())
            for p in begins(w) | begins(other):
                before = having[p]
                after = before - (out and p in begins(w)) + (new and p in begins(other))
                for least, mark in ((1, "^"), (2, "2^")):
                    if before >= least > after:
                        lost.add(mark + p)
                    elif after >= least > before:
                        gained.add(mark + p)
            yield lost, gained, words[w]


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: F.Column, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, y) of about per_class labelled documents of each class, and the weight of each class's rows."""
    known = labels.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y")).where(learn)
    counts = {int(r[0]): r[1] for r in known.groupBy("y").count().collect()}
    share = {y: min(1.0, per_class / n) for y, n in counts.items()}
    if not share:
        return None, {}
    u = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30))
    keep = F.lit(False)
    for y, p in share.items():
        keep = keep | ((F.col("y") == y) & (u < p))
    picked = known.where(keep).select(F.col("doc_id").alias("_d"), "y")  # per_class a class: small enough to send to every task
    return docs.join(F.broadcast(picked), F.col("doc_id") == F.col("_d")).select("text", "y"), {y: 1 / p for y, p in share.items()}


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column, per_class: int = 5000, n_features: int = 512, least_gain: float = 10.0, ridge: float = 0.003, fairness: float = 10.0, identity=IDENTITY) -> Model:
    """docs: doc_id, text; labels: doc_id, y (0/1); learn: which doc_ids teach."""
    sample, weight = labelled_sample(docs, labels, learn, per_class)
    total = sum(weight.values())
    if set(weight) != {0, 1}:
        n = {y: 1 for y in weight}
        p = 0.0 if not n.get(1) else 1.0
        return Model({}, 30.0 if p and total else -30.0, frozenset())
    sample = Workspace(docs.sparkSession).cut(sample, "labelled")

    def count(frames):
        seen: dict[str, list[int]] = {}
        for x in frames:
            for t, y in zip(x["text"], x["y"], strict=True):
                for f in features(set(WORD.findall((t or "").lower()))):
                    seen.setdefault(f, [0, 0])[int(y)] += 1
                if len(seen) > 50_000:
                    yield pd.DataFrame([(f, *c) for f, c in seen.items()], columns=["f", "n0", "n1"])
                    seen = {}
        yield pd.DataFrame([(f, *c) for f, c in seen.items()], columns=["f", "n0", "n1"])

    sizes = {int(r[0]): r[1] for r in sample.groupBy("y").count().collect()}
    a, b = sizes.get(1, 0) + 1.0, sizes.get(0, 0) + 1.0
    p1, p0 = (F.col("n1") + 0.5) / a, (F.col("n0") + 0.5) / b
    gain = F.col("n1") * F.log(p1 / p0) + F.col("n0") * F.log(p0 / p1)
    table = sample.mapInPandas(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    best = table.where((F.col("n1") >= 3) & (p1 > 3 * p0)).select("f", gain.alias("g")).where(F.col("g") > least_gain).orderBy(F.desc("g"), "f").limit(n_features).collect()
    terms = [t for group in identity for t in group]
    names = sorted({r["f"] for r in best} | {f for t in terms for f in features({t})})
    at, starts = {f: i for i, f in enumerate(names)}, starts_of(names)
    group_of: dict[str, set] = {}  # a word of several lists meets the others of each
    for group in identity:
        for t in group:
            group_of.setdefault(t, set()).update(group)

    def vectors(frames):
        for x in frames:
            rows = []
            for t, y in zip(x["text"], x["y"], strict=True):
                rows.append((int(y), [at[f] for f in active(t, at, starts)], None, 1))
                for s in SENTENCE.split(t or ""):
                    for lost, gained, times in swaps(Counter(WORD.findall(s.lower())), group_of):
                        rows.append((int(y), sorted(at[f] for f in lost if f in at), sorted(at[f] for f in gained if f in at), times))
            yield pd.DataFrame(rows, columns=["y", "x", "gained", "times"])

    laid = sample.mapInPandas(vectors, "y int, x array<int>, gained array<int>, times long")
    own = laid.where(F.col("gained").isNull()).groupBy("y", F.array_sort("x").alias("x")).count().collect()
    # a swap's difference holds the features of two terms: as many values as there are pairs of terms, times what beginnings they share with neighbours
    pairs = laid.where(F.col("gained").isNotNull()).groupBy("x", "gained").agg(F.sum("times").alias("count")).collect()
    k = len(names)
    X = np.zeros((len(own), k + 1), dtype=np.float32)
    for i, r in enumerate(own):
        X[i, r["x"]] = 1
    X[:, k] = 1
    y = np.array([r["y"] for r in own], dtype=np.float64)
    c = np.array([r["count"] * weight[r["y"]] for r in own]) / total
    c = c / c.sum()
    Q = np.diag(np.append(np.full(k, ridge / max(len(own), 1) * 10), 1e-9))
    mass = sum(r["count"] for r in pairs)
    for r in pairs:
        d = np.zeros(k + 1)
        d[r["x"]] += 1
        d[r["gained"]] -= 1
        on = np.flatnonzero(d)
        Q[np.ix_(on, on)] += fairness * r["count"] / mass * np.outer(d[on], d[on])
    w = np.zeros(k + 1)
    for _ in range(25):  # Newton steps on the convex loss
        z = np.clip(X @ w, -30, 30)
        p = 1 / (1 + np.exp(-z))
        grad = X.T @ (c * (p - y)) + Q @ w
        h = (X * (c * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ X + Q
        step = np.linalg.solve(h + 1e-9 * np.eye(k + 1), grad)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return Model({f: float(v) for f, v in zip(names, w[:k], strict=True) if abs(v) > 1e-6}, float(w[k]), starts)


def scorer(model: Model):
    """The model's score as a column function of texts."""
    return by_text(lambda texts: pa.array([model.score(t) for t in texts], pa.float64()), "double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` of every whole text."""

    return docs.select(docs[id_col].cast("long").alias("doc_id"), scorer(model)(docs[text_col]).alias("score"))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, **how) -> Model:
    """On documents that are not held out. labels: doc_id, toxic."""
    return fit(docs.select("doc_id", "text"), labels.select("doc_id", F.col("toxic").alias("y")), ~held_out(), **how)


def toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of docs."""
    return score(docs, train(docs, labels, **how)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they are; null and empty texts score the intercept."""
    return docs.where(scorer(train(docs, labels, **how))(docs["text"]) < threshold)
