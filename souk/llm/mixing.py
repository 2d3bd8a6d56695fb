"""Mixing to target weights with soft domain membership.

1. A labelled table teaches a multinomial logistic regression over hashed byte
   1- to 3-grams (at most about ``per_domain`` rows of each domain, chosen by a
   hash of the id). It gives every text posteriors p over the domains.
2. Each document d gets a rate r_d >= ``least``: the number of times it is
   wanted. With t_d its tokens, the rates minimise

       sum_k (sum_d r_d t_d p_dk - T_k)^2 / T_k  +  ridge * sum_d t_d (r_d - 1)^2

   by accelerated projected gradient steps. A step needs the K expected totals
   alone, one distributed sum; a document's rate follows from its posteriors and
   the steps so far, so no iterate is ever stored or shuffled.
3. ``copies`` is the rate rounded down or up so that what the roundings of a task
   add up to stays near zero in every domain (error diffusion: each document,
   largest first in its batch, is rounded the way that brings the sum of all so
   far, in tokens per domain over the targets, closer to zero). So a task's
   copies miss its rates' totals by less than its largest documents.

Tokens are words between white space; the packing's own ids are another measure.
Targets are weights per domain; without a given ``total`` it is the smallest
one for which no domain has to shrink, so with ``least = 1`` nothing is lost.
The fit ends where every domain is within ``tolerance`` of its target, or where
the loss no longer falls (what the targets ask for may be out of reach of the
rates allowed); ``Fit`` says which, and with what residual.

Edge cases: null and empty texts have no tokens and the posteriors of an empty
text; without a labelled row there are no domains and every rate is 1; a domain
without expected tokens or weight is not fitted; rows that repeat get equal
rates each; null ids are kept; docs' columns travel in a struct of their own, so
names never clash.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import Workspace, by_text

DIM = 2048
BLOCK = 1 << 20


def vector(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out = np.zeros(DIM, dtype=np.int64)
    for at in range(0, len(raw), BLOCK):
        b = raw[at : at + BLOCK + 2].astype(np.uint32)
        gram = np.zeros(len(b), dtype=np.uint32)
        for n in range(1, 4):
            if len(b) < n:
                break
            gram = gram[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
            g = gram if at + BLOCK >= len(raw) else gram[:BLOCK]
            out += np.bincount((g * np.uint32(2654435761) + np.uint32(n)) >> np.uint32(21), minlength=DIM)
    v = np.log1p(out)
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32)


class Classifier(NamedTuple):
    domains: list[str]
    W: np.ndarray
    b: np.ndarray

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.domains)))
        for lo in range(0, len(texts), 256):
            z = np.stack([vector(t) for t in texts[lo : lo + 256]]) @ self.W + self.b
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out[lo : lo + 256] = e / e.sum(axis=1, keepdims=True)
        return out


def train(labelled: DataFrame, per_domain: int = 400, steps: int = 150, ridge: float = 1e-4) -> Classifier:
    """labelled: doc_id, text, domain (null: teaches nothing)."""
    labelled = labelled.where("domain is not null and doc_id is not null").select("doc_id", "text", F.col("domain").cast("string").alias("domain"))
    sizes = {r[0]: r[1] for r in labelled.groupBy("domain").count().collect()}
    names = sorted(sizes)
    if not names:
        return Classifier([], np.zeros((DIM, 0)), np.zeros(0))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for d, n in sizes.items():
        keep = keep | ((F.col("domain") == d) & (u < min(1.0, per_domain / n)))

    def vectors(frames):
        for x in frames:
            yield pd.DataFrame({"domain": x["domain"], "v": [vector(t).tobytes() for t in x["text"]]})

    got = labelled.where(keep).select("text", "domain").mapInPandas(vectors, "domain string, v binary").collect()
    if len(names) == 1 or not got:
        return Classifier(names[:1], np.zeros((DIM, 1), dtype=np.float32), np.zeros(1))
    X = np.stack([np.frombuffer(bytes(r["v"]), dtype=np.float32) for r in got])
    own = np.array([names.index(r["domain"]) for r in got])
    Y = np.eye(len(names), dtype=np.float32)[own]
    c = (np.array([sizes[n] for n in names]) / np.maximum(np.bincount(own, minlength=len(names)), 1))[own]  # true class shares
    c = (c / c.sum()).astype(np.float32)
    W, b = np.zeros((DIM, len(names)), dtype=np.float32), np.zeros(len(names), dtype=np.float32)
    lastW, lastb, rate = W, b, 2.0
    for i in range(steps):
        m = i / (i + 3)
        yW, yb = W + m * (W - lastW), b + m * (b - lastb)
        z = X @ yW + yb
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - Y) * c[:, None]
        lastW, lastb = W, b
        W, b = yW - rate * (X.T @ g + ridge * yW), yb - rate * g.sum(axis=0)
    return Classifier(names, W, b)


def replay(p: np.ndarray, steps: list[tuple[np.ndarray, float]], eta: float, ridge: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps so far and the point the next gradient is taken at. A step: (residuals over targets, next momentum)."""
    r = np.ones(len(p))
    y = r
    for g, m in steps:
        new = np.maximum(least, y - eta * (p @ g + ridge * (y - 1)))
        r, y = new, new + m * (new - r)
    return r, y


class Fit(NamedTuple):
    domains: list[str]
    target: np.ndarray
    steps: list
    eta: float
    total: np.ndarray
    converged: bool = True

    @property
    def residual(self) -> float:
        """Largest deviation of a fitted domain's expected tokens from its target, over the target."""
        live = self.target > 0
        return float(np.abs(self.total[live] / self.target[live] - 1).max()) if live.any() and self.steps else 0.0


def _matrix(p: pa.Array, k: int) -> np.ndarray:
    return p.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _totals(rows: DataFrame, k: int, f) -> np.ndarray:
    """Sum over all rows of f(p, tokens), a vector."""

    def each(frames):
        total = None
        for x in frames:
            if x.num_rows:
                v = f(_matrix(x["p"], k), x["tokens"].to_numpy().astype(np.float64))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["cell", "v"])

    got = {r[0]: r[1] for r in rows.select("tokens", "p").mapInArrow(each, "cell int, v double").groupBy("cell").agg(F.sum("v")).collect()}
    return np.array([got[i] for i in range(len(got))])


def solve(rows: DataFrame, domains: list[str], weights: dict[str, float] | None, total: float | None, ridge: float, least: float, rounds: int, tolerance: float, temper: float) -> Fit:
    """rows: tokens, p. Fits the rates of all rows by at most ``rounds`` steps; momentum starts anew where the loss rises."""
    k = len(domains)
    found = _totals(rows, k, lambda p, t: np.append(t @ p, (p.T @ (p * t[:, None])).ravel())) if k else np.zeros(0)
    if not len(found) or found[:k].sum() <= 0:
        return Fit(domains, np.zeros(k), [], 0.0, np.zeros(k))
    natural, A = found[:k], found[k:].reshape(k, k)
    w = natural**temper if weights is None else np.array([float(weights.get(d, 0.0)) for d in domains])
    w = np.where(natural > 1e-9 * natural.sum(), w, 0)
    if w.sum() <= 0:
        return Fit(domains, natural, [], 0.0, natural)
    w = w / w.sum()
    live = w > 0
    T = w * (total or (natural[live] / w[live]).max())
    inv = np.where(live, 1 / np.maximum(T, 1e-300), 0)
    scale = np.sqrt(inv)
    eta = 1 / (np.linalg.eigvalsh(A * np.outer(scale, scale)).max() + ridge)
    steps: list = []
    theta, last, still = 1.0, np.inf, 0
    for _ in range(rounds):
        totals = _totals(rows, k, lambda p, t, steps=list(steps): (replay(p, steps, eta, ridge, least)[1] * t) @ p)
        g = (totals - T) * inv
        loss = float((g * (totals - T)).sum() / T.sum())
        still = still + 1 if abs(last - loss) < 1e-9 else 0
        if np.abs(g).max() < tolerance or still > 2:
            return Fit(domains, T, steps, eta, totals)
        if loss > last:
            theta = 1.0
        last = loss
        after = (1 + (1 + 4 * theta * theta) ** 0.5) / 2
        steps.append((g, (theta - 1) / after))
        theta = after
    return Fit(domains, T, steps, eta, totals, False)


def diffuse(r: np.ndarray, t: np.ndarray, p: np.ndarray, scale: np.ndarray, carry: np.ndarray) -> np.ndarray:
    """Copies of a batch's rows; carry (changed): what roundings so far lack, per domain in units of scale."""
    copies = np.floor(r)
    rest, v = r - copies, p * t[:, None] * scale
    size = (v * v).sum(axis=1)
    for i in np.argsort(-t, kind="stable"):
        if size[i] > 0:
            carry += rest[i] * v[i]
            if carry @ v[i] > size[i] / 2 and rest[i] > 0:
                copies[i] += 1
                carry -= v[i]
        elif rest[i] >= 0.5:
            copies[i] += 1
    return copies.astype(np.int64)


def rated(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None, total: float | None = None, least: float = 0.0, ridge: float = 1e-3, rounds: int = 120, tolerance: float = 5e-3, temper: float = 0.8, found: list | None = None) -> DataFrame:
    """docs' rows as struct ``doc`` with ``tokens, p, rate, copies``. A ``found`` list gets the Fit; one that did not converge warns.

    weights: domain -> weight; none: the domains' expected shares to the power ``temper``.
    """
    ws = Workspace(docs.sparkSession)
    model = train(labelled)
    k = len(model.domains)

    def classify(texts):
        p = model.posteriors(texts) if k else np.zeros((len(texts), 0))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * k), pa.array(p.ravel()))
        return pa.StructArray.from_arrays([pa.array([len(t.split()) if t else 0 for t in texts], pa.int64()), rows], ["tokens", "p"])

    read = by_text(classify, "struct<tokens:bigint,p:array<double>>")(docs[text_col])
    table = ws.cut(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), read.alias("c")).select("doc", "c.tokens", "c.p"), "posteriors")
    fit = solve(table, model.domains, weights, total, ridge, least, rounds, tolerance, temper)
    if not fit.converged:
        warnings.warn(f"rates after {rounds} steps miss a target by {fit.residual:.2%}", stacklevel=2)
    if found is not None:
        found.append(fit)
    steps, eta = fit.steps, fit.eta
    scale = np.where(fit.target > 0, 1 / np.sqrt(np.maximum(fit.target, 1e-300)), 0) if k else np.zeros(0)

    def rates(tokens: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        carry = np.zeros(k)  # of this task
        for t, p in tokens:
            m = _matrix(p, k) if k else np.zeros((len(t), 0))
            r = replay(m, steps, eta, ridge, least)[0]
            copies = diffuse(r, t.to_numpy(zero_copy_only=False).astype(np.float64), m, scale, carry)
            yield pa.StructArray.from_arrays([pa.array(r), pa.array(copies)], ["rate", "copies"])

    rates.__annotations__ = {"tokens": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    made = F.arrow_udf(rates, "struct<rate:double,copies:bigint>").asNondeterministic()("tokens", "p")
    return table.select("doc", "tokens", "p", made.alias("m")).select("doc", "tokens", "p", "m.rate", "m.copies")


def domains_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows ``doc_id, text, domain``: a document's language and its quality label."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_d")).agg(F.min("quality").alias("_q"))
    small = docs.select("doc_id", "text", "lang").join(known, F.col("doc_id") == F.col("_d")).where("lang is not null")
    return small.select("doc_id", "text", F.concat_ws("/", "lang", F.col("_q").cast("string")).alias("domain"))


def rates(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``doc_id, tokens, posteriors, rate, copies`` per row of docs, over the domains of :func:`domains_of`."""
    return rated(docs, domains_of(docs, labels), **how).select("doc.doc_id", "tokens", F.col("p").alias("posteriors"), "rate", "copies")


def mixed(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Each row of docs as many times as its copies say."""
    out = rated(docs, domains_of(docs, labels), **how).where("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
