"""Largest inner products by vantage-point trees, one per shard.

Metric. With M the largest norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) / M and
a query q becomes (q/|q|, 0). Their distance falls as q.x grows, so nearest by
distance is largest by inner product, and the triangle inequality holds. Norms
are taken after division by the largest component, so no finite vector overflows
them. Distances only prune; what is kept is ordered by the inner product of the
given vectors in double precision, and by id where that is equal.

Shards. A tree of vantage points, fitted on a bounded sample (``SAMPLE`` vectors),
cuts space at median distances; its leaves are the shards, and every vector is put
in one. Their number grows with the table, up to one for ``PER_LEAF`` sampled
vectors; a leaf that then holds more than ``shard_rows`` vectors is cut further by
a hash. Equal vectors are searched as one and expanded at the end (at most k + 1
ids of each can matter), so a common vector does not fill a shard.

Search. Each query first visits the shard it falls in, which gives it k results
and so a distance tau. It then visits every other shard whose lower bound, by
the triangle inequality along the vantage points above it, times ``relax`` is at
most tau. In a shard, a vantage-point tree over its vectors is searched the same
way. relax = 1 never passes over a closer vector: the search is exact, ties
included. Larger values prune more.

Edge cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do those whose length is not the table's commonest (inner
products need equal lengths); rows equal in id and vector count once, an id with
several vectors is ranked by each; fewer than k candidates give what there is;
inner products beyond the largest double are infinite and so equal; null ids take
no part; extra columns are left behind.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import Workspace

LEAF = 64
SAMPLE, PER_LEAF = 16_384, 16
TIE = 1e-9  # cosines this close may be equal
SLACK = 1e-7  # of distances between points of norm 1, which come from squares


class Split(NamedTuple):
    point: np.ndarray
    radius: float
    inner: object  # Split or a leaf's number
    outer: object


def lift(X: np.ndarray, largest: float, top: float) -> np.ndarray:
    """Rows of norm 1. largest: the largest component; top: the largest norm after division by it."""
    X = X / largest / top
    return np.hstack([X, np.sqrt(np.maximum(1 - (X * X).sum(axis=1), 0))[:, None]])


def aim(Q: np.ndarray) -> np.ndarray:
    Q = Q / np.abs(Q).max(axis=1, keepdims=True)
    return np.hstack([Q / np.sqrt((Q * Q).sum(axis=1, keepdims=True)), np.zeros((len(Q), 1))])


def inner(Q: np.ndarray, X: np.ndarray) -> np.ndarray:
    """Inner products row by row, each summed the same way wherever it is taken; a sum that overflows on the way is taken again on scaled vectors."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (Q * X).sum(axis=1)
        i = np.flatnonzero(~np.isfinite(out))
        if len(i):
            q, x = np.abs(Q[i]).max(axis=1), np.abs(X[i]).max(axis=1)
            out[i] = ((Q[i] / q[:, None]) * (X[i] / x[:, None])).sum(axis=1) * q * x
        return out


def far(X: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((X * X).sum(axis=1) - 2 * (X @ p) + p @ p, 0))


def plant(X: np.ndarray, leaves: int, count: list[int], rng) -> object:
    """A tree with at most ``leaves`` leaves, numbered from left; count holds the next number."""
    if leaves <= 1 or len(X) < 8:
        count[0] += 1
        return count[0] - 1
    some = X[rng.choice(len(X), min(len(X), 16), replace=False)]
    probe = X[rng.choice(len(X), min(len(X), 256), replace=False)]
    p = max(some, key=lambda v: far(probe, v).std())  # the widest spread of distances
    d = far(X, p)
    r = float(np.median(d))
    near = d <= r
    if near.all():
        count[0] += 1
        return count[0] - 1
    return Split(p, r, plant(X[near], (leaves + 1) // 2, count, rng), plant(X[~near], leaves // 2, count, rng))


def leaf_of(node: object, X: np.ndarray) -> np.ndarray:
    out = np.zeros(len(X), dtype=np.int64)

    def walk(n, rows):
        if not len(rows):
            return
        if not isinstance(n, Split):
            out[rows] = n
            return
        near = far(X[rows], n.point) <= n.radius
        walk(n.inner, rows[near])
        walk(n.outer, rows[~near])

    walk(node, np.arange(len(X)))
    return out


def bounds(node: object, Q: np.ndarray, leaves: int) -> np.ndarray:
    """Lower bound of each query's distance to each leaf's points."""
    out = np.zeros((len(Q), leaves))

    def walk(n, low):
        if not isinstance(n, Split):
            out[:, n] = low
            return
        d = far(Q, n.point)
        walk(n.inner, np.maximum(low, d - n.radius))
        walk(n.outer, np.maximum(low, n.radius - d))

    walk(node, np.zeros(len(Q)))
    return out


def search(X: np.ndarray, lifted: np.ndarray, ids: np.ndarray, Q: np.ndarray, tau: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """k best rows of X for each query: (row numbers or -1, inner products, distances), and how many distances were computed.

    tau: what each query has found elsewhere (infinite: nothing); farther rows need not be found.
    """
    rng = np.random.default_rng(len(X))
    order = np.argsort(ids, kind="stable")
    count = [0]
    tree = plant(lifted, max(1, len(X) // LEAF), count, rng)
    of = leaf_of(tree, lifted)
    rows = {int(v): order[of[order] == v] for v in np.unique(of)}
    # inner products over all norms: cosines of points of norm 1; those nearly equal are told apart by the given vectors
    best_c, best_i = np.full((len(Q), k), -np.inf), np.full((len(Q), k), -1, dtype=np.int64)
    aimed = aim(Q)
    place = np.argsort(order)  # a row's place in the order of ids
    done, seen = leaf_of(tree, aimed), 0

    def far_of(c):
        return np.sqrt(np.maximum(2 - 2 * c, 0))  # infinite for -inf

    def look(leaf, who):
        nonlocal seen
        r = rows.get(int(leaf))
        if r is None or not len(who):
            return
        seen += len(r) * len(who)
        c = np.hstack([best_c[who], aimed[who] @ lifted[r].T])
        i = np.hstack([best_i[who], np.broadcast_to(r, (len(who), len(r)))])
        pick = np.argpartition(-c, k - 1, axis=1)[:, :k]
        last = np.take_along_axis(c, pick, 1).min(axis=1)
        best_c[who], best_i[who] = np.take_along_axis(c, pick, 1), np.take_along_axis(i, pick, 1)
        for w in np.flatnonzero(((c >= last[:, None] - TIE) & (i >= 0)).sum(axis=1) > k):
            sure = np.flatnonzero((c[w] > last[w] + TIE) & (i[w] >= 0))
            near = np.flatnonzero((np.abs(c[w] - last[w]) <= TIE) & (i[w] >= 0))
            exact = inner(np.broadcast_to(Q[who[w]], (len(near), Q.shape[1])), X[i[w, near]])
            keep = np.append(sure, near[np.lexsort((place[i[w, near]], -exact))])[:k]
            best_c[who[w]], best_i[who[w]] = c[w, keep], i[w, keep]

    for leaf in np.unique(done):
        look(leaf, np.flatnonzero(done == leaf))

    def walk(n, who, low):
        if not len(who):
            return
        go = low * relax <= np.minimum(tau[who], far_of(best_c[who].min(axis=1))) + SLACK
        who, low = who[go], low[go]
        if not len(who):
            return
        if not isinstance(n, Split):
            look(n, who[done[who] != n])
            return
        d = far(aimed[who], n.point)
        walk(n.inner, who, np.maximum(low, d - n.radius))
        walk(n.outer, who, np.maximum(low, n.radius - d))

    walk(tree, np.arange(len(Q)), np.zeros(len(Q)))
    exact = np.full(best_i.shape, -np.inf)
    for j in range(k):
        on = np.flatnonzero(best_i[:, j] >= 0)
        exact[on, j] = inner(Q[on], X[best_i[on, j]])
    return best_i, exact, far_of(best_c), seen


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array<double>) of the rows that take part."""
    v = df[vec_col].cast("array<double>")
    t = df.select(df[id_col].cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    t = t.where(~bad).where(F.exists("v", lambda x: x != 0))
    sizes = t.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return t.where(F.size("v") == (sizes["n"] if sizes else 0))


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", queries=None, k: int = 20, relax: float = 1.35, shard_rows: int = 8192, query_rows: int = 8192, measured: list | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k largest inner products among all other ids.

    queries: a condition on ``id`` that tells queries (all rows, if none). A
    ``measured`` list gets the number of (query, shard) visits and of all such pairs.
    """
    ws = Workspace(df.sparkSession)
    spark = ws.spark
    alive = ws.cut(usable(df, id_col, vec_col), "vectors")
    largest, dim = alive.agg(F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    result = "query_id long, rank int, vec_id long, score double"
    if largest is None:
        return spark.createDataFrame([], result)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / largest) * (x / largest)))
    top = float(alive.agg(F.max(norm)).first()[0]) * (1 + 1e-12)
    wide = k + 1
    # equal vectors: one row to search for, and their wide smallest ids
    key = F.xxhash64("v")
    members = alive.select("id", "v").distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= wide)
    members = ws.cut(members.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "members")
    n = members.count()
    share = min(1.0, SAMPLE / n)
    sample = members.where(F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").collect()
    count = [0]
    sample = np.array([r["v"] for r in sample]).reshape(-1, dim)
    tree = plant(lift(sample, largest, top), max(1, min(n // shard_rows, len(sample) // PER_LEAF)), count, np.random.default_rng(1)) if len(sample) else 0
    leaves = max(1, count[0])

    def assign(frames):
        for x in frames:
            X = np.stack(x["v"].to_numpy()) if len(x) else np.zeros((0, dim))
            yield x[["rep", "v"]].assign(leaf=leaf_of(tree, lift(X, largest, top)).astype(np.int32))

    laid = ws.cut(members.select("rep", "v").mapInPandas(assign, "rep long, v array<double>, leaf int"), "leaves")
    sizes = {r[0]: r[1] for r in laid.groupBy("leaf").count().collect()}
    cuts = {leaf: max(1, -(-c // shard_rows)) for leaf, c in sizes.items()}
    part_of = F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv])
    laid = laid.withColumn("cut", F.pmod(F.xxhash64("rep"), part_of[F.col("leaf")]).cast("int"))
    cond = queries if queries is not None else F.lit(True)
    asked = alive.where(cond).select(F.col("id").alias("q"), "v").distinct()

    def visit(asks: DataFrame) -> DataFrame:
        """asks: q, v, tau, leaf -> q, rep, score, dist of each shard's best."""
        asks = ws.cut(asks.withColumn("cut", F.explode(F.sequence(F.lit(0), part_of[F.col("leaf")] - 1))), "asks")
        chunks = asks.groupBy("leaf", "cut").agg(F.count("*").alias("n")).select("leaf", "cut", F.ceil(F.col("n") / query_rows).cast("int").alias("chunks"))
        chunks = ws.cut(chunks, "chunks")
        shards = laid.join(chunks, ["leaf", "cut"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        asks = asks.join(chunks, ["leaf", "cut"]).withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int"))

        def run(_, own, who):
            if not len(own) or not len(who):
                return pd.DataFrame({"q": [], "rep": [], "score": [], "dist": []})
            X, Q = np.stack(own["v"].to_numpy()), np.stack(who["v"].to_numpy())
            i, score, d, _seen = search(X, lift(X, largest, top), own["rep"].to_numpy(), Q, who["tau"].to_numpy(np.float64), min(wide, len(X)), relax)
            at, col = np.nonzero(i >= 0)
            return pd.DataFrame({"q": who["q"].to_numpy()[at], "rep": own["rep"].to_numpy()[i[at, col]], "score": score[at, col], "dist": d[at, col]})

        keys = ["leaf", "cut", "chunk"]
        return shards.select(*keys, "rep", "v").groupBy(*keys).cogroup(asks.select(*keys, "q", "v", "tau").groupBy(*keys)).applyInPandas(run, "q long, rep long, score double, dist double")

    def home(frames):
        for x in frames:
            Q = np.stack(x["v"].to_numpy()) if len(x) else np.ones((0, dim))
            low = bounds(tree, aim(Q), leaves)
            low[:, [v for v in range(leaves) if v not in sizes]] = np.inf
            yield x.assign(tau=np.inf, leaf=low.argmin(axis=1).astype(np.int32))

    first = ws.cut(asked.mapInPandas(home, "q long, v array<double>, tau double, leaf int"), "homes")
    near = ws.cut(visit(first), "near")
    tau = near.groupBy("q").agg(F.array_sort(F.collect_list("dist")).alias("d")).select("q", F.when(F.size("d") >= wide, F.col("d")[wide - 1]).otherwise(float("inf")).alias("far"))

    def others(frames):
        for x in frames:
            Q = np.stack(x["v"].to_numpy()) if len(x) else np.ones((0, dim))
            low = bounds(tree, aim(Q), leaves)
            go = low * relax <= x["far"].to_numpy()[:, None] + SLACK
            go[np.arange(len(x)), x["leaf"].to_numpy()] = False
            at, leaf = np.nonzero(go)
            keep = np.isin(leaf, list(sizes))
            yield pd.DataFrame({"q": x["q"].to_numpy()[at[keep]], "v": x["v"].to_numpy()[at[keep]], "tau": x["far"].to_numpy()[at[keep]], "leaf": leaf[keep].astype(np.int32)})

    rest = first.join(tau, "q", "left").withColumn("far", F.coalesce("far", F.lit(float("inf")))).mapInPandas(others, "q long, v array<double>, tau double, leaf int")
    rest = ws.cut(rest, "others")
    if measured is not None:
        measured += [rest.count() + first.count(), first.count() * len(sizes)]
    found = near.unionByName(visit(rest)).select("q", "rep", "score")
    top_classes = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= wide)
    ids = members.select(F.col("rep").alias("mr"), "ids")
    each = top_classes.join(ids, F.col("rep") == F.col("mr")).select("q", "score", F.explode("ids").alias("vec_id")).where("q <> vec_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int"), "vec_id", "score")
