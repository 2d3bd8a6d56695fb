"""Language identification by nearest centroids.

A text is the TF-IDF vector of the 1- to 4-grams of its lower-cased UTF-8 bytes,
where whatever is ASCII and no letter counts as one blank, hashed to ``DIM``
numbers and normalised. Each language has up to ``clusters`` centroids
(spherical k-means), so plain prose, lists and shouting get their own. The
nearest centroid by cosine gives the language and the score; a text farther from
it than nearly all that made it (``quantile`` of their distances, and a slack)
is marked ``rejected``.

Document frequencies count every learnable text. Centroids are fitted on about
``per_language`` texts of each language, chosen by a hash of the id; that is
the expected number and so the bound, and each language is fitted in a task of
its own.

Edge cases: a text that is null or has no letter is ``und`` with score 0 (it
teaches nothing); whole texts count, however long; rows that repeat are each
predicted; rows without a language teach nothing; without any
learnable row all are ``und``; null ids teach nothing and are never held out.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import by_text, small_batches

DIM = 4096
BLOCK = 1 << 20
UNKNOWN = "und"
#: Each byte, with a blank for what is ASCII and no letter.
PLAIN = np.array([b if b > 127 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint8)


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter of any script; ``²``, ``½`` and ``Ⅷ`` are numbers."""
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Counts of hashed 1- to 4-grams of a whole text."""
    raw = PLAIN[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    blank = raw == 32
    raw = raw[~(blank & np.append(False, blank[:-1]))]
    out = np.zeros(DIM, dtype=np.int64)
    for at in range(0, len(raw), BLOCK):
        b = raw[at : at + BLOCK + 3].astype(np.uint32)
        last = at + BLOCK >= len(raw)
        gram = np.zeros(len(b), dtype=np.uint32)
        for n in range(1, 5):
            if len(b) < n:
                break
            gram = gram[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
            g = gram if last else gram[:BLOCK]  # each gram counts where it begins
            out += np.bincount((g * np.uint32(2654435761) + np.uint32(n)) >> np.uint32(20), minlength=DIM)
    return out


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(text)) * idf
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32)


def cluster(X: np.ndarray, k: int, quantile: float, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids and how far their texts lie. Seeds: drawn by distance. Centroids of one text go, if others stay."""
    rng = np.random.default_rng(7)
    seeds = [int(np.argmax(X @ X.mean(axis=0)))]
    far = np.maximum(1 - X @ X[seeds[0]], 0)
    while len(seeds) < min(k, len(X)) and far.max() > 1e-6:
        seeds.append(int(rng.choice(len(X), p=far / far.sum())))
        far = np.minimum(far, np.maximum(1 - X @ X[seeds[-1]], 0))
    C = X[seeds].copy()
    for _ in range(rounds):
        own = np.argmax(X @ C.T, axis=1)
        for j in range(len(C)):
            if (own == j).any():
                m = X[own == j].mean(axis=0)
                C[j] = m / max(np.linalg.norm(m), 1e-9)
    d, own = 1 - (X @ C.T).max(axis=1), np.argmax(X @ C.T, axis=1)
    size = np.bincount(own, minlength=len(C))
    used = np.flatnonzero(size > 1) if (size > 1).any() else np.flatnonzero(size)
    return C[used], np.array([np.quantile(d[own == j], quantile) for j in used])


class Model(NamedTuple):
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    reach: np.ndarray
    slack: float

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        at = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for lo in range(0, len(at), 256):
            rows = at[lo : lo + 256]
            cos = np.stack([vector(texts[i], self.idf) for i in rows]) @ self.centroids.T
            best = np.argmax(cos, axis=1)
            for i, j, c in zip(rows, best.tolist(), cos.max(axis=1).tolist(), strict=True):
                out[i] = self.languages[j], min(max(c, 0.0), 1.0), bool(1 - c > self.reach[j] + self.slack)
        return out


def fit(rows: DataFrame, per_language: int = 500, clusters: int = 6, quantile: float = 0.99, slack: float = 0.05) -> Model:
    """rows: doc_id, text, lang, all of which may teach."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}

    def frequency(frames):
        n, df = 0, np.zeros(DIM, dtype=np.int64)
        for x in frames:
            for t in x["text"]:
                if has_letter(t):
                    n, df = n + 1, df + (counts(t) > 0)
        yield pd.DataFrame({"cell": np.arange(DIM + 1), "v": np.append(df, n)})

    got = {r[0]: r[1] for r in rows.select("text").mapInPandas(frequency, "cell int, v long").groupBy("cell").agg(F.sum("v")).collect()}
    df, n = np.array([got.get(i, 0) for i in range(DIM)]), got.get(DIM, 0)
    idf = np.log((1 + n) / (1 + df)) + 1e-3 if n else np.ones(DIM)
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for lang, c in sizes.items():
        keep = keep | ((F.col("lang") == lang) & (u < min(1.0, per_language / c)))

    def vectors(frames):
        for x in frames:
            ok = [(t, g) for t, g in zip(x["text"], x["lang"], strict=True) if has_letter(t)]
            yield pd.DataFrame({"lang": [g for _, g in ok], "v": [vector(t, idf).tobytes() for t, _ in ok]})

    def group(key, x):
        C, reach = cluster(np.stack([np.frombuffer(v, dtype=np.float32) for v in sorted(x["v"])]), clusters, quantile)  # sorted: a task that runs again finds the same
        return pd.DataFrame({"lang": key[0], "centroid": [c.tobytes() for c in C], "reach": reach})

    made = rows.where(keep).select("text", "lang").mapInPandas(vectors, "lang string, v binary").groupBy("lang").applyInPandas(group, "lang string, centroid binary, reach double").collect()
    made = sorted(made, key=lambda r: (r["lang"], bytes(r["centroid"])))
    C = np.stack([np.frombuffer(bytes(r["centroid"]), dtype=np.float32) for r in made]) if made else np.zeros((0, DIM), dtype=np.float32)
    return Model(idf, [r["lang"] for r in made], C, np.array([r["reach"] for r in made]), slack)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` per row."""

    def each(texts):
        lang, score, far = zip(*model.predict(texts), strict=True) if texts else ((),) * 3
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], ["lang_pred", "score", "rejected"])

    found = by_text(each, "struct<lang_pred:string,score:double,rejected:boolean>")(docs[text_col])
    return docs.select(docs[id_col].cast("long").alias("doc_id"), found.alias("p")).select("doc_id", "p.*")


def identify(docs: DataFrame, **how) -> DataFrame:
    """Learn from rows that are not held out and predict all: ``doc_id, held_out, lang_pred, score, rejected``."""
    small_batches(docs.sparkSession)
    model = fit(docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~held_out()), **how)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
