"""Ranked targets and diversity-balanced assortments.

An assortment has at most some forty picks, a business limit; candidates have no
limit. A pick's score depends on the picks before it, but only falls by what they
touch, so old values bound it: the best rows of each collection by a bound are fetched
in one job, and picks are made among them for as long as they beat what was not
fetched (see ``Frontier``). Pruning never changes the result (see ``prune``).
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions import config as C
from souk.functions import rules
from souk.session import written


def pick_targets(df: DataFrame, group: str, score: str, key: str, cap: int, top: int | None = None, limit: int | None = None, where: Column | None = None, done: Column | None = None) -> DataFrame:
    """Best first, at most ``cap`` per group, the first ``top`` of these, without those done, at most ``limit``."""
    out = df if where is None else df.where(where)
    out = out.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))).where(F.col("_r") <= cap).drop("_r")
    out = out.orderBy(F.desc(score), key)
    out = out.limit(top) if top is not None else out
    out = out if done is None else out.where(~done)
    return out if limit is None else out.orderBy(F.desc(score), key).limit(limit)


def concept(name: Column, key: Column) -> Column:
    """First four telling words of the name, sorted; the key where there is none."""
    words = F.filter(F.split(rules.slug(name), "-"), lambda w: (w != "") & ~w.isin(*C.CONCEPT_STOPWORDS))
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.slice(words, 1, 4)), "-"), F.lit("")), key)


def line_key(supplier: Column, collection: Column, price: Column) -> Column:
    """Same supplier, collection and rounded price: one product line. No price, no key."""
    return F.when(price.isNotNull(), F.concat_ws("|", supplier, collection, F.bround(price.cast("decimal(18,6)"), 0).cast("long").cast("string")))


def build_candidates(products: DataFrame, only_new: bool = False, retired: tuple[str, ...] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """Eligible rows: product_key, supplier_key, collection, name, product_score, price, content_potential."""
    ok = F.col("review_status").isin("Shortlisted", "Manually Approved", "Enriched") & F.coalesce(F.col("selection_status"), F.lit("Not Selected")).isin("Not Selected", "Initial Candidate", "New Arrivals Candidate")
    ok = ok & F.col("is_new") if only_new else ok
    ok = ok & ~F.col("collection").isin(*retired) if retired else ok
    out = price_band(products.where(ok), "retail_price", low, high)
    content = F.least(F.lit(1.0), 0.4 + 0.15 * F.coalesce(F.size("image_urls"), F.lit(0)))
    return out.select("product_key", F.coalesce("supplier_key", F.lit("unknown")).alias("supplier_key"), "collection", F.col("product_name").alias("name"), F.col("product_score").cast("double").alias("product_score"), F.col("retail_price").cast("double").alias("price"), content.alias("content_potential"))


def price_band(df: DataFrame, price: str, low: float | None, high: float | None) -> DataFrame:
    """Rows whose price lies in the band; with a bound set, rows without a price drop."""
    out = df if low is None else df.where(F.col(price) >= low)
    return out if high is None else out.where(F.col(price) <= high)


def marked(pool: DataFrame) -> DataFrame:
    return pool.withColumns({"concept": concept(F.col("name"), F.col("product_key")), "line": line_key(F.col("supplier_key"), F.col("collection"), F.col("price"))})


def prune(pool: DataFrame, k: int) -> DataFrame:
    """Rows that k picks could take; the others never win.

    Rows equal in collection, supplier, concept, price and content always get
    the same adjustment: the best one suffices (two without a price, where only
    the concept limit of 2 applies). And with b = score + 4 content: of the best
    row of each supplier, then of these of each concept, one pick touches at most
    two; if a collection has 2k + 1 of them, T being the last one's b, an
    untouched one scores at least T plus the common bonus, so rows with
    b + 3 < T cannot win. The same floor on the score alone keeps what a
    score-only phase could take.
    """
    same = Window.partitionBy("collection", "supplier_key", "concept", "price", "content_potential").orderBy(F.desc("product_score"), "product_key")
    out = pool.withColumn("_r", F.row_number().over(same)).where((F.col("_r") == 1) | (F.col("price").isNull() & (F.col("_r") <= 2))).drop("_r")

    def floor(value: Column, name: str) -> DataFrame:
        best = out.groupBy("collection", "supplier_key").agg(F.max(F.struct(value.alias("b"), "concept")).alias("m")).select("collection", "m.*")
        best = best.groupBy("collection", "concept").agg(F.max("b").alias("b"))
        nth = best.withColumn("_r", F.row_number().over(Window.partitionBy("collection").orderBy(F.desc("b")))).where(F.col("_r") == 2 * k + 1)
        return nth.select(F.col("collection").alias("_" + name), F.col("b").alias(name))

    b = F.col("product_score") + 4 * F.col("content_potential")
    one, two = floor(b, "f1"), floor(F.col("product_score"), "f2")
    met = out.join(one, F.col("collection") == F.col("_f1"), "left").join(two, F.col("collection") == F.col("_f2"), "left")
    return met.where(F.col("f1").isNull() | F.col("f2").isNull() | (b + 3 >= F.col("f1")) | (F.col("product_score") >= F.col("f2"))).drop("_f1", "f1", "_f2", "f2")


class State:
    """What the picks so far amount to; one entry per pick at most."""

    def __init__(self, picks: list) -> None:
        self.picks = list(picks)

    def count(self, field: str) -> dict:
        out: dict = {}
        for p in self.picks:
            out[p[field]] = out.get(p[field], 0) + 1
        return out

    def rules(self, sel: C.Selection, per_supplier: int, per_collection: int | None = None) -> tuple[Callable, Callable, Callable]:
        """allowed(row), score(row) and bound(collection, value) as the picks stand."""
        suppliers, concepts, collections = (self.count(f) for f in ("supplier_key", "concept", "collection"))
        lines, taken = {p["line"] for p in self.picks if p["line"] is not None}, {p["product_key"] for p in self.picks}
        prices = [p["price"] for p in self.picks if p["price"] is not None]
        mean = sum(prices) / len(prices) if prices else None
        most = per_collection or sel.per_collection_max

        def bonus(name) -> float:
            n = collections.get(name, 0)
            return 6 * (sel.per_collection_min - n) / sel.per_collection_min if n < sel.per_collection_min else 0.0

        def allowed(r: dict) -> bool:
            return collections.get(r["collection"], 0) < most and suppliers.get(r["supplier_key"], 0) < per_supplier and concepts.get(r["concept"], 0) < sel.max_concept and (r["line"] is None or r["line"] not in lines) and r["product_key"] not in taken

        def score(r: dict) -> float:
            spread = min(3.0, 3.0 * abs(r["price"] - mean) / max(1.0, mean)) if mean is not None and r["price"] is not None else 0.0
            return r["product_score"] + bonus(r["collection"]) - 4 * suppliers.get(r["supplier_key"], 0) + spread + 4 * r["content_potential"] - 8 * concepts.get(r["concept"], 0)

        def bound(name, value: float) -> float | None:
            return value + bonus(name) + 3.0 + 1e-9 if collections.get(name, 0) < most else None

        return allowed, score, bound


class Frontier:
    """The best rows of each collection by ``product_score + 4 content_potential``, fetched some at a time; picks are made among them.

    A row that is not fetched scores at most its collection's last fetched value, plus
    the collection's bonus and the largest price spread (3). Penalties only lower that,
    so a fetched row above all these bounds is the pick of the whole pool, and one job
    serves many picks. Where a bound is not beaten, that collection's rows are fetched
    to four times the depth. What the driver holds are ``depth`` rows a collection, and more
    as often as that happens; a pruned pool's rows seldom make it happen twice.
    """

    def __init__(self, pool: DataFrame, depth: int = 256) -> None:
        self.pool, self.sizes = pool, {r["collection"]: r["n"] for r in pool.groupBy("collection").agg(F.count("*").alias("n")).collect()}
        self.depth, self.rows, self.last = dict.fromkeys(self.sizes, 0), {}, {}
        self.jobs = 1
        self.fetch(list(self.sizes), depth)

    def fetch(self, names: list, depth: int) -> None:
        value = F.col("product_score") + 4 * F.col("content_potential")
        parts = [self.pool.where(F.col("collection").eqNullSafe(n)).withColumn("_b", value).orderBy(F.desc("_b"), F.desc("product_score"), "product_key").limit(depth) for n in names]
        got = functools.reduce(DataFrame.unionByName, parts).collect() if parts else []
        self.jobs += bool(parts)
        for n in names:
            mine = [r.asDict() for r in got if r["collection"] == n]
            self.rows[n], self.depth[n] = mine, depth
            self.last[n] = min((r["_b"] for r in mine), default=0.0) if len(mine) < self.sizes[n] else None  # None: all are here

    def best(self, allowed: Callable, score: Callable, bound: Callable):
        """The allowed row of highest (score, product_score), then least key; bound(collection, last fetched value): what other rows score at most, None where none is allowed."""
        while True:
            live = [(score(r), r) for rows in self.rows.values() for r in rows if allowed(r)]
            top = min(live, key=lambda x: (-x[0], -x[1]["product_score"], x[1]["product_key"]), default=None)
            open_ = [n for n, last in self.last.items() if last is not None and (most := bound(n, last)) is not None and (top is None or most >= top[0])]
            if not open_:
                return None if top is None else top[1] | {"selection_score": top[0]}
            deeper = max(self.depth[n] for n in open_) * 4
            self.fetch(open_, deeper)


def _result(pool: DataFrame, picks: list) -> DataFrame:
    rows = [(i + 1, p["product_key"], p["supplier_key"], p["collection"], p["concept"], p["product_score"], p["price"]) for i, p in enumerate(picks)]
    return pool.sparkSession.createDataFrame(rows, "pick int, product_key string, supplier_key string, collection string, concept string, product_score double, price double")


def _fill(front: Frontier, state: State, sel: C.Selection, want: int, per_supplier: int, per_collection: int | None = None) -> None:
    """Picks by falling selection score until there are ``want``, or none is allowed."""
    while len(state.picks) < want:
        best = front.best(*state.rules(sel, per_supplier, per_collection))
        if best is None:
            return
        state.picks.append(best)


def select_assortment(pool: DataFrame, sel: C.Selection, seed: list | None = None, free: int | None = None) -> tuple[DataFrame, list[str]]:
    """Up to ``total_max`` picks in order, and notes on what fell short. seed: rows already kept; free: how many to add."""
    front, state = Frontier(written(prune(marked(pool), sel.total_max))), State(seed or [])
    start = len(state.picks)
    _fill(front, state, sel, sel.total_max if free is None else start + free, sel.per_supplier_max)
    notes = [] if len(state.picks) >= sel.total_min else [f"only {len(state.picks)} picks, fewer than {sel.total_min}"]
    counts = state.count("collection")
    notes += [f"{c}: {counts.get(c, 0)} picks, fewer than {sel.per_collection_min}" for c in (C.KITCHEN, C.DINING, C.COMFORT, C.BATHROOM) if counts.get(c, 0) < sel.per_collection_min]
    return _result(pool, state.picks[start:]), notes


def select_new_arrivals(pool: DataFrame, sel: C.Selection, preferred: tuple[str, ...] = (C.KITCHEN, C.COMFORT, C.CATCH_ALL), total: int = 4, per_supplier: int = 2) -> DataFrame:
    """The best of each preferred collection in turn, then greedy up to total; a collection may fill the batch, and one product of it is enough."""
    front, state = Frontier(written(prune(marked(pool), max(total, len(preferred))))), State([])
    for name in preferred:
        if len(state.picks) < total:
            allowed, _, _ = state.rules(sel, per_supplier, total)
            best = front.best(lambda r, ok=allowed, n=name: r["collection"] == n and ok(r), lambda r: r["product_score"], lambda n, value, own=name: value if n == own else None)  # content counts at least 0
            if best is not None:
                state.picks.append(best)
    _fill(front, state, replace(sel, per_collection_min=1), total, per_supplier, total)
    return _result(pool, state.picks)


def reject_and_backfill(selected: DataFrame, pool: DataFrame, rejected: list[str], sel: C.Selection) -> DataFrame:
    """Freed places only: the other picks stay and count; rejected ones never come back."""
    rows = [r.asDict() for r in marked(selected).collect()]  # an assortment: at most total_max rows
    kept = [r for r in rows if r["product_key"] not in set(rejected)]
    rest = pool.where(~F.col("product_key").isin([r["product_key"] for r in rows] or [""]))
    return select_assortment(rest, sel, kept, len(rows) - len(kept))[0]


def make_batch(selected: DataFrame, batch: str, notes: list[str]) -> DataFrame:
    """One row: counts per collection and in all, members in order, notes."""
    return selected.agg(F.count("*").alias("total"), *[F.count_if(F.col("collection") == c).alias(c.lower().replace(" ", "_")) for c in (C.KITCHEN, C.DINING, C.COMFORT, C.BATHROOM, C.CATCH_ALL)], F.array_join(F.array_sort(F.collect_list("product_key")), ", ").alias("members")).select(F.lit(batch).alias("batch"), "*", F.lit("; ".join(notes)).alias("notes"))
