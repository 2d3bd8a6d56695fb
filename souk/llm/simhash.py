"""SimHash near-duplicates by generalised pigeonhole search in Hamming space.

A text's fingerprint has 64 bits; two fingerprints link at ``radius`` or fewer
differing bits, and the links' connected components are the groups of copies.

Search. The 64 bits are dealt into ``m`` partitions, correlated bits together
(co-occurrence counts over all fingerprints, 64 x 64 numbers). For thresholds
t_1..t_m with sum ``radius - m + 1``, any two linked fingerprints agree within
t_i bits in some partition i (t_i = -1: not probed). Each fingerprint gets its
own thresholds by dynamic programming on estimated candidate counts: the exact
count of its own value in a partition, plus the mean count per flipped value.
It then probes an index of all fingerprints and verifies what it meets.

Crowded values. A fingerprint whose cheapest plan still expects more than
``crowd`` candidates is not probed pair by pair. Two fingerprints differ in at
most 2 bits exactly when they share a node of {f} + {f with one bit flipped},
and at most 65 fingerprints touch a node; crowded ones meet there, in linear
work, and their links to uncrowded ones come from the latter's probes, which
read the whole index. So no partner is lost and no group is paired out.

Edge cases: null, empty and short texts as in :func:`fingerprint`; a null id
keeps its row and takes the smallest id of its component (null if none); rows
that repeat stay as they are; extra columns are left behind.

:mod:`souk.llm.overlap` verifies such links by the texts' shingles, adds those
that 64 bits cannot show, and keeps one row of each group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import Workspace, by_text, components, words

BITS = 64
SEED = 42
BLOCK = 1 << 16


def _hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of lower-cased (A-Z) words, in blocks."""
    w = [x.lower() for x in words(text)]  # bytes.lower() touches A-Z alone
    if not w:
        return
    if len(w) < shingle:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], dtype=np.uint64)
        return
    one = xxhash.xxh64_intdigest
    for at in range(0, len(w) - shingle + 1, BLOCK):
        part = w[at : at + BLOCK + shingle - 1]
        yield np.fromiter((one(x, SEED) for x in map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))), dtype=np.uint64)


def fold(blocks: Iterable[np.ndarray]) -> int:
    """Bit b is 1 if it is set in over half the hashes; without any: 0. Unsigned."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for h in blocks:
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int((2 * ones > n).astype(np.uint64) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64))) if n else 0


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a text's shingles, repeats included; no words: 0."""
    return fold(_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (the 64 bits as a signed long)."""
    each = by_text(lambda texts: pa.array(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)), "long")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), each(docs[text_col]).alias("fp"))


def bit_groups(classes: DataFrame, m: int) -> list[list[int]]:
    """Deal 64 bits into m equal groups, each grown from its seed by the strongest correlation."""

    def each(frames):
        n, c = 0, np.zeros((BITS, BITS))
        for x in frames:
            b = np.unpackbits(x["fp"].to_numpy(np.int64).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, c = n + len(b), c + b.T @ b
        yield pd.DataFrame({"cell": np.arange(BITS * BITS + 1), "v": np.append(c.ravel(), n)})

    got = {r["cell"]: r["v"] for r in classes.select("fp").mapInPandas(each, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()}
    n = max(got.get(BITS * BITS, 0), 1)
    c = np.array([got.get(i, 0.0) for i in range(BITS * BITS)]).reshape(BITS, BITS) / n
    p = np.diag(c)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((c - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(r, -1)
    free, out = set(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        group = [max(sorted(free), key=lambda i: max((r[i, j] for j in free if j != i), default=0))]
        free -= set(group)
        while len(group) < size:
            nxt = max(sorted(free), key=lambda i: np.mean([r[i, j] for j in group]))
            group.append(nxt)
            free.remove(nxt)
        out.append(sorted(group))
    return out


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def allocate(counts: np.ndarray, widths: list[int], mean: list[float], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds per row by dynamic programming; returns (thresholds n x m, expected candidates n).

    Cost of threshold t in partition i: the probes, plus the row's own count,
    plus the mean count for each value reached by 1..t flips; -1 costs nothing.
    """
    n, m = counts.shape
    levels = range(-1, radius + 1)
    want = radius - m + 1
    lo, hi = -m, m * radius
    best = {0: np.zeros(n)}
    back: list[dict[int, np.ndarray]] = []
    for i in range(m):
        cost = {-1: np.zeros(n)}
        reach = 1.0
        for t in range(radius + 1):
            if t:
                reach *= (widths[i] - t + 1) / t
                cost[t] = cost[t - 1] + reach * (1 + mean[i])
            else:
                cost[0] = 1 + counts[:, i]
        nxt: dict[int, np.ndarray] = {}
        arg: dict[int, np.ndarray] = {}
        for s, have in best.items():
            for t in levels:
                to = s + t
                if not lo <= to <= hi:
                    continue
                c = have + cost[t]
                if to not in nxt:
                    nxt[to], arg[to] = c.copy(), np.full(n, t)
                else:
                    less = c < nxt[to]
                    nxt[to][less], arg[to][less] = c[less], t
        best = nxt
        back.append(arg)
    out, s = np.empty((n, m), dtype=np.int64), np.full(n, want)
    for i in reversed(range(m)):
        for v in np.unique(s):
            rows = s == v
            out[rows, i] = back[i][int(v)][rows]
        s = s - out[:, i]
    return out, best[want]


def links(ws: Workspace, classes: DataFrame, radius: int = 2, m: int | None = None, crowd: int = 128) -> DataFrame:
    """Verified links ``a``, ``b`` between distinct fingerprints ``fp`` that keep every component whole.

    m: 3 partitions of about 21 bits up to 2^24 fingerprints, 2 of 32 beyond, unless given.
    """
    if radius > 2:
        raise ValueError("crowded fingerprints meet at one-bit flips, which hold for a radius of at most 2")
    total = classes.count()
    m = m or (3 if total <= 1 << 24 else 2)
    m = min(m, radius + 1)
    groups = bit_groups(classes, m)
    masks = [_signed(sum(1 << b for b in g)) for g in groups]
    index = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.col("fp").bitwiseAND(F.lit(k)).alias("v")) for i, k in enumerate(masks)])).alias("e")).select("fp", "e.p", "e.v")
    sizes = index.groupBy("p", "v").agg(F.count("*").alias("c"))
    means = {r["p"]: r["q"] for r in sizes.groupBy("p").agg((F.sum(F.col("c") * F.col("c")) / F.sum("c") / 1.0).alias("q")).collect()}
    # a flipped value is met as often as a random one: N * sum p^2 is the mean count of a value that occurs; spread over the values that could
    mean = [min(means.get(i, 0.0), total / 2.0 ** min(len(g), 40) + 1.0) for i, g in enumerate(groups)]
    widths = [len(g) for g in groups]
    counted = index.join(sizes, ["p", "v"]).select("fp", "p", "c")
    wide = counted.groupBy("fp").agg(*[F.max(F.when(F.col("p") == i, F.col("c"))).alias(f"c{i}") for i in range(m)])

    def plan(frames):
        for x in frames:
            t, cost = allocate(x[[f"c{i}" for i in range(m)]].to_numpy(np.float64), widths, mean, radius)
            yield pd.DataFrame({"fp": x["fp"], "crowded": cost > crowd + sum(widths) * radius} | {f"t{i}": t[:, i] for i in range(m)})

    planned = ws.cut(wide.mapInPandas(plan, "fp long, crowded boolean, " + ", ".join(f"t{i} long" for i in range(m))), "plan")

    def flips(bits: list[int], t: int) -> list[int]:
        out, layer = [0], [(0, -1)]
        for _ in range(t):
            layer = [(v | 1 << bits[j], j) for v, at in layer for j in range(at + 1, len(bits))]
            out += [v for v, _ in layer]
        return [_signed(v) for v in out]

    def probe(i: int):
        v = F.col("fp").bitwiseAND(F.lit(masks[i]))
        cases = F.when(F.col(f"t{i}") < 0, F.array().cast("array<bigint>"))
        for t in range(radius + 1):
            cases = cases.when(F.col(f"t{i}") == t, F.array(*[v.bitwiseXOR(F.lit(x)) for x in flips(groups[i], t)]))
        return F.transform(cases, lambda x: F.struct(F.lit(i).alias("p"), x.alias("v")))

    asks = planned.where(~F.col("crowded")).select(F.col("fp").alias("q"), F.explode(F.concat(*[probe(i) for i in range(m)])).alias("e")).select("q", F.col("e.p").alias("qp"), F.col("e.v").alias("qv"))
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius
    probed = asks.join(index, (F.col("qp") == F.col("p")) & (F.col("qv") == F.col("v")) & (F.col("q") != F.col("fp")) & near).select(F.col("q").alias("a"), F.col("fp").alias("b"))
    nodes = [0] + [_signed(1 << b) for b in range(BITS)] if radius == 2 else [0]
    met = planned.where("crowded").select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in nodes])).alias("node"))
    met = met.groupBy("node").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    shared = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a != b")
    if radius < 2:  # distance 1: a flip of one is the other
        one = planned.where("crowded").select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(BITS)])).alias("node"))
        other = planned.where("crowded").select(F.col("fp").alias("o"))
        shared = one.join(other, F.col("node") == F.col("o")).select(F.col("fp").alias("a"), F.col("o").alias("b")) if radius == 1 else shared
    return probed.unionByName(shared)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, crowd: int = 128) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable), one row per row of docs."""
    ws = Workspace(docs.sparkSession)
    each = ws.cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = ws.cut(each.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = components(ws, links(ws, classes, radius, crowd=crowd))
    joined = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    joined = ws.cut(joined, "roots")
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    of = ws.cut(joined.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"), "components")
    return each.join(of, F.col("fp") == F.col("f"), "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
