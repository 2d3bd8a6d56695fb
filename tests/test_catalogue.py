"""Literal cases, invariants and replays."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.functions import config as C
from souk.functions import rules as R
from souk.operators import insight, pricing, publish, scoring, selection, upsert
from souk.sources import export, pages


def one(spark, rule, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", rule(F.col("v")).alias("o")).orderBy("i").collect()]


def test_literal_rules(spark):
    assert one(spark, R.price, ["4,50", "1.250,75", "1,250.75", "1,250", "1.250", "€ 9.9", "-", None, "1,250,000", "x"]) == [4.5, 1250.75, 1250.75, 1250.0, 1.25, 9.9, None, None, None, None]
    links = {
        "HTTPS://Shop.Example.com/A/?utm_source=x&b=2&a=1#top": "https://shop.example.com/A?a=1&b=2",
        "https://Example.com/Product/123/?utm_source=x&gclid=y&color=red": "https://example.com/Product/123?color=red",
        "https://shop.com/": "https://shop.com/", "https://shop.com": "https://shop.com", "shop.com/x/": "shop.com/x", "/": None, "": None, " ": None,
        "https://e.com/p?q=a%20b&r=%7E": "https://e.com/p?q=a+b&r=~", "https://e.com/p?x=%zz&e=&n&=v": "https://e.com/p?=v&x=%25zz", "https://e.com/p?b=%C3%BC&b=1&s=*": "https://e.com/p?b=1&b=%C3%BC&s=%2A",
        "//CDN.com/a//": "https://cdn.com/a", "mailto:a@B.c": "mailto:a@B.c", "https://e.com/p#section": "https://e.com/p", "https://e.com/p?RefeRRer=1": "https://e.com/p",
    }
    assert one(spark, R.url, [*links, None]) == [*links.values(), None]
    assert one(spark, R.slug, ["ﬁne ½ ™ É", "Ⅷ"]) == ["fine-12-tm-e", "viii"]
    assert one(spark, R.country, ["usa", "Deutschland", "new zealand", "FRANCE", "u.s.", " ", None]) == ["United States", "Germany", "New Zealand", "FRANCE", "U.s.", None, None]
    assert one(spark, R.country_list, ["usa; USA|italia", None]) == [["United States", "Italy"], []]
    assert one(spark, R.tri_bool, ["Yes", "0", "perhaps", None]) == [True, False, None, None]
    assert one(spark, R.as_int, ["3.9", "x", "1d", "nan", "1e3", None]) == [3, None, None, None, 1000, None]
    assert one(spark, R.slug, ["Crème Brûlée  Set!", "straße", None]) == ["creme-brulee-set", "strae", ""]
    assert one(spark, R.strip_html, ["<p>a&nbsp;&amp;lt;b</p>", "<br>"]) == ["a <b", None]
    assert one(spark, R.text, [" a \n b ", "\t"]) == ["a b", None]
    assert one(spark, lambda c: R.clip(c, 5), ["abcd, efg", "abc"]) == ["abcd", "abc"]
    assert one(spark, R.dimensions, ["box 10 x 20 cm", "none"]) == ["10 × 20cm".replace(" × ", "  ×  "), None]
    assert one(spark, R.weight, ["about 1,5 kg", "5 stars"]) == ["1,5kg", None]
    assert one(spark, R.material, ["aus Edelstahl", "bambus holz", "air"]) == ["Stainless steel", "Bamboo", None]
    assert one(spark, R.redact_json, ['{"token": "a", "n": {"Password":1}, "x": 2}']) == ['{"token": "***REDACTED***", "n": {"Password":"***REDACTED***"}, "x": 2}']
    assert [str(t)[:10] if t else t for t in one(spark, R.ts_utc, ["2026-07-20 03:47:01", "2026-07-20", "1700000000", "bad"])] == ["2026-07-20", "2026-07-20", "2023-11-14", None]


def test_keys_fall_down_the_ladder(spark):
    df = spark.createDataFrame([("7", None, "N", "DE"), (None, "https://x.y/", "N", "DE"), (None, None, "N", "DE"), (None, None, " ", None)], "sid string, u string, n string, c string")
    keys = [r.k for r in df.select(R.supplier_key(*[F.col(c) for c in df.columns]).alias("k")).collect()]
    assert keys[0] == "sid:7" and keys[1].startswith("surl:") and keys[2].startswith("shash:") and keys[3] is None


def test_scope_lookaheads_match_python(spark):
    said = ["lavender soap", "soap dispenser", "candle holder", "candles", "perfume bottle", "perfume", "ring holder", "gold ring", "cosmetics", "oak table", "soap  dish and soap"]
    want = [bool(re.search("|".join(f"(?:{p})" for p in C.EXCLUDED), s)) for s in said]
    assert one(spark, scoring.is_excluded, said) == want


def test_page_files_in_three_shapes(spark, tmp_path):
    kind = T.StructType([T.StructField("id", T.StringType()), T.StructField("price", T.StringType())])
    (tmp_path / "a.json").write_text(json.dumps({"pages": [{"products": [{"id": "1", "price": "4,50"}], "cursor": "p1"}, {"products": [{"id": "2"}, {"id": "3"}], "cursor": "p2"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"products": [{"id": "4"}]}))
    (tmp_path / "c.json").write_text(json.dumps([{"id": "5"}, {"id": "6"}]))
    rows = pages.read_pages(spark, str(tmp_path), kind).orderBy("id").collect()
    assert [(r.id, r.page_no, r.pos, r.cursor) for r in rows] == [("1", 1, 0, "p1"), ("2", 2, 0, "p2"), ("3", 2, 1, "p2"), ("4", 1, 0, None), ("5", 1, 0, None), ("6", 1, 1, None)]


def test_worst_case_shipping(spark):
    zone = "array<struct<cost:double,min_days:int,max_days:int,locations:array<string>>>"
    df = spark.createDataFrame([(1, [(8.5, 2, 12, ["ES", "FR"]), (3.0, 1, 4, ["DE"]), (99.0, 9, 99, ["ES"])]), (2, []), (3, None), (4, [(1.0, 1, 1, ["US"])])], f"i int, z {zone}")
    got = {r.i: r.w for r in df.select("i", pages.market_shipping(F.col("z"), ["ES", "FR", "DE", "IT"]).alias("w")).collect()}
    assert tuple(got[1]) == (8.5, 1, 12, 3) and got[2] is None and got[3] is None and got[4].covered == 0


def test_items_and_responses(spark):
    df = spark.createDataFrame([(1, '{"total": 2, "result": [{"A": {"B": [5]}}, {"A": null}]}'), (2, "{}")], "page int, raw string")
    out = pages.explode_response(df, "raw", "result", "total").orderBy("page", "pos").collect()
    assert [(r.page, r.pos, r.total) for r in out] == [(1, 0, 2), (1, 1, 2), (2, None, None)]
    arr = df.select(pages.pull_item_field(F.array(F.lit('{"url":"u"}'), F.lit("v")), "url").alias("x")).first().x
    assert arr == ["u", "v"]


def test_margin_cases(spark):
    row = (10.0, None, False, 40.0), (10.0, 5.0, True, 40.0), (None, 5.0, True, 40.0), (10.0, 5.0, True, None), (30.0, 5.0, True, 40.0)
    df = spark.createDataFrame(list(row), "supplier_price double, shipping_cost double, shipping_cost_known boolean, suggested_retail_price double")
    m = pricing.margin(df, C.Margin()).collect()
    assert [r.margin_status for r in m] == ["Target Met", "Acceptable", "Incomplete", "Incomplete", "Below Minimum"]
    assert [str(r.landed_cost) for r in m[:2]] == ["15.50", "19.00"] and m[0].shipping_estimated and not m[1].shipping_estimated
    t = pricing.margin(df, C.Margin(mode="target_margin")).first()
    assert abs(float(t.margin_pct) - 55) <= 0.1


@pytest.mark.parametrize("have, origin", [((0, 1, 2), "cache"), ((1, 2), "live"), ((0, 2), "cache"), ((2,), "fallback")])
def test_rate_choice(spark, have, origin):
    rows = [("cache", 100.0, "USD", 0.9), ("live", 200.0, "USD", 0.91), ("fallback", 0.0, "USD", 0.92)]
    df = spark.createDataFrame([rows[i] for i in have], "origin string, fetched_at double, currency string, rate double")
    assert {r.origin for r in pricing.choose_rates(df, 150.0, 86_400.0).collect()} == {origin}
    empty = spark.createDataFrame([("cache", 0.0, "USD", 0.9), ("live", 1e6, None, None), rows[2]], df.schema)
    assert {r.origin for r in pricing.choose_rates(empty, 1e6, 10.0).collect()} == {"fallback"}


def random_pool(rng, n):
    cols = [C.KITCHEN, C.DINING, C.BATHROOM]
    return [(f"p{i:03d}", f"s{rng.randint(0, 4)}", rng.choice(cols), f"{rng.choice('red blue oak tin'.split())} {rng.choice('bowl pan mat'.split())}", float(rng.randint(50, 99)), rng.choice([None, 10.0, 19.9, 20.1, 35.0]), rng.choice([0.4, 0.7, 1.0])) for i in range(n)]


def greedy(rows, sel):
    picks, pool = [], sorted(rows, key=lambda r: (-r["product_score"], r["product_key"]))
    count = lambda f, v: sum(p[f] == v for p in picks)
    while len(picks) < sel.total_max:
        best = None
        for r in pool:
            if r in picks or count("collection", r["collection"]) >= sel.per_collection_max or count("supplier_key", r["supplier_key"]) >= sel.per_supplier_max or count("concept", r["concept"]) >= 2 or (r["line"] and r["line"] in {p["line"] for p in picks}):
                continue
            n, prices = count("collection", r["collection"]), [p["price"] for p in picks if p["price"] is not None]
            s = r["product_score"] + (6 * (sel.per_collection_min - n) / sel.per_collection_min if n < sel.per_collection_min else 0) - 4 * count("supplier_key", r["supplier_key"])
            if r["price"] is not None and prices:
                mean = sum(prices) / len(prices)
                s += min(3.0, 3.0 * abs(r["price"] - mean) / max(1.0, mean))
            s += 4 * r["content_potential"] - 8 * count("concept", r["concept"])
            if best is None or s > best[0] + 1e-12:
                best = (s, r)
        if best is None:
            return picks
        picks.append(best[1])
    return picks


def test_pruned_distributed_greedy_is_the_plain_greedy(spark):
    rng, sel = random.Random(11), C.Selection(total_min=3, total_max=5, per_collection_min=1, per_collection_max=2, max_supplier_share_pct=40)
    df = spark.createDataFrame(random_pool(rng, 80), "product_key string, supplier_key string, collection string, name string, product_score double, price double, content_potential double")
    rows = [r.asDict() for r in selection.marked(df).collect()]
    got, notes = selection.select_assortment(df, sel)
    keys = [r.product_key for r in got.orderBy("pick").collect()]
    assert keys == [r["product_key"] for r in greedy(rows, sel)] and notes
    kept = {r.product_key for r in selection.prune(selection.marked(df), 5).collect()}
    assert set(keys) <= kept
    picked = df.where(F.col("product_key").isin(keys))
    filled = {r.product_key for r in selection.reject_and_backfill(picked, df, keys[:2], sel).collect()}
    assert not filled & set(keys) and len(filled) <= 2


def test_forty_picks_in_few_jobs(spark, monkeypatch):
    """The loop's picks, however few rows are fetched at first, and at most ten fetches."""
    rng, sel, made = random.Random(6), C.Selection(), []
    df = spark.createDataFrame(random_pool(rng, 1500), "product_key string, supplier_key string, collection string, name string, product_score double, price double, content_potential double")
    want = [r["product_key"] for r in greedy([r.asDict() for r in selection.marked(df).collect()], sel)]

    class Watched(selection.Frontier):
        def __init__(self, pool, depth=256):
            super().__init__(pool, first or depth)
            made.append(self)

    monkeypatch.setattr(selection, "Frontier", Watched)
    for first in (4, None):
        got, _ = selection.select_assortment(df, sel)
        assert [r.product_key for r in got.orderBy("pick").collect()] == want
        assert made[-1].jobs <= 10


def arrivals(rows, total=4, cap=2):
    """One of each preferred collection, then the best by score with a bonus for collections not yet met."""
    picks, pool = [], sorted(rows, key=lambda r: (-r["product_score"], r["product_key"]))
    count = lambda f, v: sum(p[f] == v for p in picks)

    def free(r):
        return r not in picks and count("collection", r["collection"]) < total and count("supplier_key", r["supplier_key"]) < cap and count("concept", r["concept"]) < 2 and not (r["line"] and r["line"] in {p["line"] for p in picks})

    def score(r):
        prices = [p["price"] for p in picks if p["price"] is not None]
        mean = sum(prices) / len(prices) if prices else 0
        spread = min(3.0, 3.0 * abs(r["price"] - mean) / max(1.0, mean)) if prices and r["price"] is not None else 0
        return r["product_score"] + 6 * (not count("collection", r["collection"])) - 4 * count("supplier_key", r["supplier_key"]) + spread + 4 * r["content_potential"] - 8 * count("concept", r["concept"])

    for name in (C.KITCHEN, C.COMFORT, C.CATCH_ALL):
        best = next((r for r in pool if r["collection"] == name and free(r)), None)
        picks += [best] if best and len(picks) < total else []
    while len(picks) < total and any(map(free, pool)):
        picks.append(max((r for r in pool if free(r)), key=lambda r: round(score(r), 9)))
    return [r["product_key"] for r in picks]


@pytest.mark.parametrize("suppliers, names", [(5, (C.KITCHEN, C.COMFORT, C.CATCH_ALL, C.DINING)), (1, (C.KITCHEN, C.COMFORT)), (6, (C.KITCHEN,))])
def test_new_arrivals_are_those_of_the_loop(spark, suppliers, names):
    rng = random.Random(suppliers)
    rows = [(f"p{i:03d}", f"s{rng.randrange(suppliers)}", rng.choice(names), f"thing{rng.randrange(9)} a{i}", float(rng.randint(50, 99)), rng.choice([None, 9.0, 20.0, 35.0]), rng.choice([0.4, 0.7])) for i in range(40)]
    df = spark.createDataFrame(rows, "product_key string, supplier_key string, collection string, name string, product_score double, price double, content_potential double")
    got = [r.product_key for r in selection.select_new_arrivals(df, C.Selection()).orderBy("pick").collect()]
    assert got == arrivals([r.asDict() for r in selection.marked(df).collect()]) and (suppliers > 1 or len(got) == 2)


def test_funnel_ends_in_the_greedy_assortment(spark, sf):
    from souk.plans import insights

    pool, stages = insights._funnel(spark, sf)
    rows, sel = [r.asDict() for r in selection.marked(pool).collect()], C.Selection()
    assert [r.product_key for r in insights.ps6_funnel(spark, sf).orderBy("pick").collect()] == [r["product_key"] for r in greedy(rows, sel)]
    assert stages["enriched"].count() <= 120 and stages["scanned"].count() == spark.read.parquet(f"{sf}/part.parquet").count()


def test_stems_stand_wherever_a_pattern_matches(spark):
    said = ["an electric blanket, wired", "a led", "ledger", "food-grade and foodgrade", "pokémon pokemon", "hello kitty", "anti bacterial", "spider-man", "super  mario", "supermario", "size chart: fits", "PAW", "paw patrol", "nothing", "é220v 220v"]
    want = [[f for f, p in C.RISKS if re.search(p, s)] for s in said]
    assert one(spark, lambda _: scoring.risk_flags("v"), said) == want


def test_running_values_across_spans(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 5), rng.choice([None, rng.randint(0, 99)])) for i in rng.sample(range(500), 120)]
    got = upsert.running(spark.createDataFrame(rows, "o long, a long, b long"), "o", {"s": (F.sum, F.col("a")), "m": (F.max, F.col("b"))}, span=16).collect()
    for r in got:
        before = [x for x in rows if x[0] <= r.o]
        assert r.s == sum(x[1] for x in before) and r.m == max((x[2] for x in before if x[2] is not None), default=None)


def test_endpoints_have_their_place(spark, sf):
    """Likely ones first, then as first seen, in one numbering however many ranges the order is cut into."""
    rows = [(i, "get" if i % 3 else "post", f"h{i * 7 % 40}", i * 7 % 40 % 4 == 0) for i in range(200)]
    log = spark.createDataFrame(rows, "seq int, m string, e string, likely boolean")
    got = insight.endpoint_summary(log, "m", "e", "seq", F.col("likely")).collect()
    want = {(r.m, r.e): (r.first_seen, r.likely_api) for r in got}
    assert [(r.m, r.e) for r in sorted(got, key=lambda r: r.place)] == sorted(want, key=lambda k: (not want[k][1], want[k][0]))
    assert sorted(r.place for r in got) == list(range(1, len(got) + 1))
    from souk.plans import insights

    assert "place" in insights.ag12_endpoints(spark, sf).columns


def test_stock_words_follow_the_status(spark, sf):
    from souk.plans import rules

    words = {"O": "In Stock", "F": "Out Of Stock"}
    want = sorted((r.o_orderkey, words.get(r.o_orderstatus, "Unknown")) for r in spark.read.parquet(f"{sf}/orders.parquet").collect())
    assert sorted((r.o_orderkey, r.stock) for r in rules.pj8_stock_status(spark, sf).collect()) == want and len({w for _, w in want}) == 3


def test_no_filter_repeats_the_margin(spark, sf):
    """The winners' condition stands above the limit, not below the margin's steps."""
    from souk.plans import insights

    plan = insights.rk13_top_winners(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "bround" not in "".join(x for x in plan.splitlines() if "Filter" in x)


def test_texts_are_spread_for_the_exclusions(spark, sf):
    from souk.plans import catalogue

    for f in (catalogue.pg2_scope_exclusion, catalogue.pg2_scope_exclusion_plain):
        assert f(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_products_are_dealt_out_before_they_are_scored(spark, sf, monkeypatch):
    """A table of products is one file split; it was scored in one task."""
    from souk.operators import funnel
    from souk.plans import catalogue, insights

    seen, once = [], funnel.written
    monkeypatch.setattr(funnel, "written", lambda df: seen.append(df) or once(df))
    insights._funnel(spark, sf)
    for df in (seen[0], catalogue.job(spark, sf)):
        assert "RepartitionByExpression [product_key" in df._jdf.queryExecution().optimizedPlan().toString()


def test_upsert_twice_is_upsert_once(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string").withColumn("fp", F.sha2("v", 256))
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string").withColumn("fp", F.sha2("v", 256))
    once = upsert.upsert(a, b, "k", "fp", ["v"])
    assert {(r.k, r.v, r._action) for r in once.collect()} == {(1, "x", "untouched"), (2, "z", "updated"), (3, "w", "created")}
    twice = upsert.upsert(once.drop("_action"), b, "k", "fp", ["v"])
    assert {r._action for r in twice.where("k > 1").collect()} == {"unchanged"}
    assert {tuple(r) for r in twice.drop("_action").collect()} == {tuple(r) for r in once.drop("_action").collect()}


def test_early_stop_reads_to_the_page_end(spark):
    rows = [(p, i, f"k{p}{i}") for p in range(6) for i in range(3)]
    df = spark.createDataFrame(rows, "page int, pos int, k string")
    known = df.where("page >= 2 and page <> 4").select("k")
    cut = lambda n, m: max(r.page for r in upsert.early_stop(df, known, "k", "page", "pos", n, m).collect())
    assert cut(2, 99) == 2 and cut(6, 99) == 3 and cut(99, 2) == 3 and cut(99, 99) == 5


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, None, 'q"x')], "id int, tags array<string>, note string")
    export.export_csv(df, ["id", "note", "tags"], str(tmp_path / "csv"), "now")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).orderBy("id").collect()
    assert [(r.id, r.note, r.tags) for r in back] == [("1", None, "a; b"), ("2", 'q"x', None)]
    export.export_json(df, str(tmp_path / "json"), "now")
    assert spark.read.json(str(tmp_path / "json/manifest")).first()["count"] == 2


def test_schema_check_and_fenced_answers(spark):
    bad = spark.createDataFrame([("k", "Nonsense")], "product_key string, review_status string")
    assert {(r.column_name, r.violation) for r in insight.validate_table(bad, "products").collect()} == {("product_name", "missing column"), ("review_status", "unknown option")}
    said = spark.createDataFrame([(1, '```json\n{"title": "T"}\n```'), (2, 'Sure: {"title": "U"} ok'), (3, "no"), (4, "{broken")], "i int, a string")
    got = {r.i: (r.content, r.error) for r in publish.parse_responses(said, "a").collect()}
    assert got[1][0] == '{"title": "T"}' and got[2][0] == '{"title": "U"}' and got[3] == (None, "no JSON object") and got[4][0] is None


def test_weights_must_add_up():
    with pytest.raises(ValueError):
        C.Scoring({"a": 50}, 0, 1)
