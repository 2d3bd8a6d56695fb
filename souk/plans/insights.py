"""Gallery, statistics, facets, histograms, publishing tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from souk.functions import config as C
from souk.functions.views import VIEWS
from souk.operators import funnel, insight, pricing, publish, rescoring, scoring
from souk.operators.selection import select_assortment
from souk.plans.base import OFFERS, PRODUCTS, SUPPLIERS, margin_sql, offers, products, query, suppliers
from souk.plans.catalogue import CFG, JOB, SCORED, job
from souk.session import written
from souk.sources.pages import read_table

PRICED = f"{PRODUCTS}, {margin_sql('prod')}"


def priced(spark, d):
    return pricing.margin(products(spark, d), CFG.margin)


# --- gallery

SHOWN = "product_key, supplier_key, product_name, retail_price, margin_pct"


@query(f"WITH {JOB}, g AS (SELECT product_key, supplier_key, product_name, collection, product_score, margin_pct, retail_price FROM classed JOIN sup USING (supplier_key) WHERE status NOT IN ('Scored Rejected', 'Gate Failed', 'Excluded By Supplier', 'Manually Rejected') AND collection = 'Dining' AND margin_pct >= 45 AND price_vs_market <= 10 AND supplier_name ILIKE '%0%' AND product_name ILIKE '%R%') SELECT product_key, collection, product_score, margin_pct FROM g ORDER BY product_score DESC NULLS LAST, product_key LIMIT 500")
def fl1_jn3_gallery(spark, d):
    shown = written(job(spark, d).select("product_key", "supplier_key", "product_name", "collection", "product_score", "margin_pct", "price_vs_market", "review_status"))  # the gallery reads a stored table
    page, _ = insight.gallery(shown, suppliers(spark, d), equal={"collection": "Dining"}, at_least={"margin_pct": 45}, at_most={"price_vs_market": 10}, viable=True, supplier="0", name="R")
    return page.select("product_key", "collection", "product_score", "margin_pct")


@query(f"WITH {PRICED} SELECT {SHOWN} FROM m4 WHERE enriched_at IS NULL AND currency IN ('EUR', 'USD') ORDER BY supplier_key ASC NULLS LAST, margin_pct DESC NULLS LAST, product_key LIMIT 50")
def rk12_gallery_grouped(spark, d):
    p = priced(spark, d).withColumn("ships_from", F.col("currency"))
    return insight.gallery(p, enriched=False, ships_from=["EUR", "USD"], sort="margin", group="supplier_key", limit=50)[0].select(*SHOWN.split(", "))


@query(f"WITH {PRICED} SELECT count(*) AS total, count(*) > 50 AS truncated FROM m4 WHERE enriched_at IS NULL")
def rk12_gallery_total(spark, d):
    return insight.gallery(priced(spark, d), enriched=False, sort="margin", limit=50)[1]


@query("SELECT o_orderkey, coalesce(s, '') NOT IN ('Scored Rejected', 'Gate Failed', 'Excluded By Supplier', 'Manually Rejected') AS viable FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Gate Failed' WHEN 'O' THEN 'Shortlisted' END AS s FROM orders)")
def fl2_viable(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "Gate Failed").when(F.col("o_orderstatus") == "O", "Shortlisted")
    return read_table(spark, d, "orders").select("o_orderkey", insight.is_viable(s).alias("viable"))


@query("""SELECT event_id, CASE WHEN regexp_full_match(k, '-?[0-9.]+') THEN TRY_CAST(k AS DOUBLE) END AS k FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""")
def fl3_numeric_guard(spark, d):
    return read_table(spark, d, "events").select("event_id", insight.number(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 910 AND 950")
def fl4_price_band(spark, d):
    from souk.operators.selection import price_band

    return price_band(read_table(spark, d, "part"), "p_retailprice", 910, 950).select("p_partkey", "p_retailprice")


VIEW_SQL = {"equals": "{c} = '{v}'", "is_true": "{c}", "is_false": "NOT {c}", "empty": "coalesce({c}::VARCHAR, '') IN ('', '[]')", "not_empty": "coalesce({c}::VARCHAR, '') NOT IN ('', '[]')"}
VIEW_TABLES = f"""s AS (WITH {SCORED} SELECT supplier_key AS k, eligibility, shipping_max_days, manual_override, active FROM scored),
p AS (WITH {JOB} SELECT product_key AS k, active, is_new, NOT blocked AS supplier_eligible, status AS review_status, CASE WHEN substr(product_key, 5)::BIGINT % 10 = 0 THEN 'Initial Candidate' WHEN substr(product_key, 5)::BIGINT % 10 = 1 THEN 'New Arrivals Candidate' WHEN substr(product_key, 5)::BIGINT % 10 = 2 THEN 'Published' ELSE selection_status END AS selection_status, margin_status, flags AS risk_flags, CASE WHEN substr(product_key, 5)::BIGINT % 10 = 3 THEN 'Needs Attention' END AS prep_status FROM classed),
r AS (SELECT o_orderkey::VARCHAR AS k, CASE o_orderstatus WHEN 'O' THEN 'Running' WHEN 'F' THEN 'Completed' ELSE 'Failed' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'Unverified' END AS completeness FROM orders)"""


@query(f"WITH {VIEW_TABLES} " + " UNION ALL ".join(f"SELECT '{name}' AS view_name, k FROM {table[0]} WHERE " + VIEW_SQL[kind].format(c=c, v=v) for table, views in VIEWS.items() for name, (c, kind, v) in views.items()))
def fl6_views(spark, d):
    """All 23 views, registered and read."""
    n = F.substring("product_key", 5, 20).cast("long") % 10
    j = job(spark, d)
    chosen = F.when(n == 0, "Initial Candidate").when(n == 1, "New Arrivals Candidate").when(n == 2, "Published").otherwise(F.col("selection_status"))
    p = j.select("active", "is_new", "review_status", "margin_status", "risk_flags", F.col("product_key").alias("k"), (~scoring.blocks_products(F.col("supplier_eligibility"))).alias("supplier_eligible"), chosen.alias("selection_status"), F.when(n == 3, "Needs Attention").alias("prep_status"))
    s = scoring.score_suppliers(suppliers(spark, d), CFG).withColumn("k", F.col("supplier_key"))
    status = F.when(F.col("o_orderstatus") == "O", "Running").when(F.col("o_orderstatus") == "F", "Completed").otherwise("Failed")
    r = read_table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"), status.alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "Unverified").alias("completeness"))
    out = None
    for table, df in (("suppliers", written(s)), ("products", written(p)), ("runs", r)):
        insight.register_views(df, {name.replace(" ", "_"): f for name, f in VIEWS[table].items()})
        for name in VIEWS[table]:
            one = spark.table(name.replace(" ", "_")).select(F.lit(name).alias("view_name"), "k")
            out = one if out is None else out.unionByName(one)
    return out


@query("SELECT * FROM (SELECT 'kind' AS column_name, o_orderstatus AS value, 'unknown option' AS violation, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'status', o_orderpriority, 'unknown option', count(*) FROM orders GROUP BY 2) UNION ALL SELECT 'run_id', NULL, 'missing column', 1")
def fl7_validate(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("status"))
    return insight.validate_table(o, "runs")


@query("SELECT o_orderkey, o_orderpriority, l_linenumber AS variant, l_partkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def jn8_product_detail(spark, d):
    o, l = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    lines = l.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("lines"))
    p = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("supplier_key", F.col("o_custkey"))
    s = read_table(spark, d, "customer").select(F.col("c_custkey").alias("supplier_key"), "c_name")
    out = insight.product_detail(p, s, F.lit(True), "lines")
    return out.select("o_orderkey", "o_orderpriority", F.col("variant.l_linenumber").alias("variant"), F.col("variant.l_partkey").alias("l_partkey"), "c_name")


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT k)), ',') AS attributes FROM (SELECT user_id, unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def jn9_variant_columns(spark, d):
    return insight.variant_columns(read_table(spark, d, "events"), "user_id", "props").select("user_id", F.array_join("attributes", ",").alias("attributes"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, n_name) AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def jn10_label_category(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("label"))
    n = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    return insight.label_category(c, n, "c_nationkey", "label").select("c_custkey", "label")


# --- aggregates


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def ag1_products_per_supplier(spark, d):
    return rescoring.relevant_counts(read_table(spark, d, "lineitem"), "l_suppkey")


ORDERS_SQL = "o AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS enriched_at, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS product_score, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS collection FROM orders)"


def orders(spark, d):
    o = read_table(spark, d, "orders")
    return o.withColumns({"enriched_at": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")), "product_score": F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")), "collection": F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority"))})


@query(f"WITH {ORDERS_SQL} SELECT count(*) AS products, count(enriched_at) AS enriched, count(product_score) AS scored, count(*) - count(enriched_at) AS unenriched, (SELECT count(*) FROM supplier) AS suppliers FROM o")
def ag2_stats(spark, d):
    return insight.stats(orders(spark, d), read_table(spark, d, "supplier"))


@query(f"WITH {ORDERS_SQL} SELECT coalesce(collection, 'Unclassified') AS label, count(*) AS total, count(enriched_at) AS enriched, count(product_score) AS scored FROM o GROUP BY 1")
def ag3_stats_by(spark, d):
    return insight.stats_by(orders(spark, d), "collection")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def ag4_status_mix(spark, d):
    from souk.operators.scoring import tally

    return tally(read_table(spark, d, "orders"), "o_orderstatus")


@query("SELECT count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) FILTER (l_tax = 0) AS untaxed, count(*) FILTER (l_quantity >= 40) AS bulk, count(*) FILTER (l_extendedprice < 1000) AS cheap FROM lineitem")
def ag5_quick_counts(spark, d):
    c = F.col
    return insight.quick_counts(read_table(spark, d, "lineitem"), returned=c("l_returnflag") == "R", open=c("l_linestatus") == "O", discounted=c("l_discount") > 0.05, untaxed=c("l_tax") == 0, bulk=c("l_quantity") >= 40, cheap=c("l_extendedprice") < 1000)


def _histogram_sql(col: str, edges: list) -> str:
    case = "CASE " + " ".join(f"WHEN {col} < {e} THEN {i}" for i, e in enumerate(edges)) + f" ELSE {len(edges)} END"
    return f"WITH {OFFERS}, {margin_sql('offer')}, h AS (SELECT {case} AS b FROM m4 WHERE {col} IS NOT NULL) SELECT i::INT AS bucket, count(b) AS n FROM range({len(edges) + 1}) r(i) LEFT JOIN h ON b = i GROUP BY 1"


@query(_histogram_sql("margin_pct", [20, 40, 50, 60]))
def ag6_margin_histogram(spark, d):
    return insight.bucket_counts(pricing.margin(offers(spark, d), CFG.margin), "margin_pct", [20, 40, 50, 60])


@query(_histogram_sql("competitiveness", [0.8, 0.95, 1.0, 1.2]))
def ag7_market_histogram(spark, d):
    return insight.bucket_counts(pricing.margin(offers(spark, d), CFG.margin), "competitiveness", [0.8, 0.95, 1.0, 1.2])


@query(f"WITH {OFFERS}, {margin_sql('offer')} SELECT p_type, count(*) FILTER (margin_pct >= 55 AND NOT uncompetitive) AS winners, count(*) AS total, grouping(p_type)::INT AS is_total FROM m4 GROUP BY ROLLUP (p_type)")
def ag8_winners_by_collection(spark, d):
    return insight.winners_by(pricing.margin(offers(spark, d), CFG.margin), "p_type", (F.col("margin_pct") >= 55) & ~F.col("uncompetitive"))


@query("SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def ag9_facets(spark, d):
    return insight.facets(read_table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT l_partkey, sum(l_quantity::DECIMAL(18,2))::DECIMAL(28,2) AS stock FROM lineitem GROUP BY 1")
def ag11_stock_total(spark, d):
    return insight.stock_total(read_table(spark, d, "lineitem"), "l_partkey", "l_quantity")


@query("SELECT lang AS method, host AS endpoint, min(page_id) AS first_seen, count(*) AS responses, arg_min(contains(html, 'track('), page_id) AS likely_api, (row_number() OVER (ORDER BY arg_min(contains(html, 'track('), page_id) DESC, min(page_id)))::INT AS place FROM (SELECT *, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM pages) GROUP BY 1, 2")
def ag12_endpoints(spark, d):
    p = read_table(spark, d, "pages").select("page_id", "html", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("method"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("endpoint"))
    return insight.endpoint_summary(p, "method", "endpoint", "page_id", F.contains("html", F.lit("track(")))


@query("SELECT l_returnflag, n, round_even((n * 100 / sum(n) OVER ()::DOUBLE)::DECIMAL(18,6), 1)::DECIMAL(5,1) AS pct FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)")
def ag13_share(spark, d):
    return insight.share(read_table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")), "n")


@query(f"WITH {OFFERS}, {margin_sql('offer')} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, margin_pct FROM m4 WHERE margin_pct >= 40 AND NOT uncompetitive ORDER BY margin_pct DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, supplier_price LIMIT 40")
def rk13_top_winners(spark, d):
    # what does not win sorts last and goes after the limit; a condition before it would be pushed below the margin's steps, and repeat them in each of its terms
    m = pricing.margin(offers(spark, d), CFG.margin).withColumn("margin_pct", F.when((F.col("margin_pct") >= 40) & ~F.col("uncompetitive"), F.col("margin_pct")))
    return m.orderBy(F.desc_nulls_last("margin_pct"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "supplier_price").limit(40).where("margin_pct IS NOT NULL").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "margin_pct")


# --- publishing


@query("SELECT 'pid:' || p_partkey AS product_key FROM part WHERE p_partkey % 53 = 0 ORDER BY p_type, p_retailprice DESC, product_key LIMIT 20")
def rk14_publish_targets(spark, d):
    p = read_table(spark, d, "part").select(F.concat(F.lit("pid:"), F.col("p_partkey").cast("string")).alias("product_key"), F.col("p_type").alias("collection"), F.col("p_retailprice").alias("product_score"), F.when(F.col("p_partkey") % 53 == 0, "Selected").alias("selection_status"))
    return publish.publish_targets(p, limit=20).select("product_key")


MATERIAL_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}') THEN '{v}'" for p, v in C.MATERIALS) + " END"


@query(f"WITH {PRODUCTS}, p AS (SELECT *, lower(product_name || ' ' || coalesce(description, '') || ' ' || category || ' ' || coalesce(subcategory, '')) AS t, CASE stock_quantity % 4 WHEN 0 THEN '{C.KITCHEN}' WHEN 1 THEN '{C.COMFORT}' WHEN 2 THEN '{C.CATCH_ALL}' WHEN 3 THEN 'Other' END AS collection FROM prod) SELECT product_key, {MATERIAL_SQL} AS material, 'House' AS vendor, CASE collection WHEN '{C.KITCHEN}' THEN 'Kitchen & Dining' WHEN '{C.COMFORT}' THEN 'Home Décor' WHEN '{C.CATCH_ALL}' THEN 'Home Storage & Organization' ELSE 'Home' END AS product_type, main_image_url AS image, concat_ws(',', collection, {MATERIAL_SQL}, 'House') AS tags, trim(regexp_replace(lower(product_name), '[^a-z0-9]+', '-', 'g'), '-') AS handle FROM p")
def cr13_cr15_cr17_publish_fields(spark, d):
    kinds = F.array(*map(F.lit, (C.KITCHEN, C.COMFORT, C.CATCH_ALL, "Other")))
    p = products(spark, d).withColumn("collection", F.get(kinds, F.col("stock_quantity") % 4))
    return publish.publish_fields(p, "House", "House").select("product_key", "material", "vendor", "product_type", "image", F.array_join("tags", ",").alias("tags"), "handle")


@query(f"WITH {PRODUCTS} SELECT product_key, product_name AS name, substr(description, 1, 30) AS description, category, brand FROM prod")
def pb1_content_requests(spark, d):
    r = publish.content_requests(products(spark, d), 30)
    return r.select("product_key", *[F.get_json_object("facts", f"$.{k}").alias(k) for k in ("name", "description", "category", "brand")])


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 3 <> 2 THEN role END AS role_in, CASE WHEN conv_id % 3 = 2 THEN 'no JSON object' END AS error FROM conversations""")
def pb2_parse_responses(spark, d):
    t = read_table(spark, d, "conversations")
    body = F.to_json(F.struct("role", "text"))
    said = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("Here you are: "), body, F.lit(" - done"))).otherwise(F.regexp_replace("text", r"[{}]", ""))
    return publish.parse_responses(t.withColumn("said", said), "said").select("conv_id", "turn", F.get_json_object("content", "$.role").alias("role_in"), "error")


CLIP = lambda c, n: f"CASE WHEN length({c}) <= {n} THEN {c} ELSE regexp_replace(substr({c}, 1, {n}), '[\\s,.;:\\-]+$', '') END"


@query(f"WITH {PRODUCTS}, c AS (SELECT *, product_name || ', ' || category || '. ' || product_name AS long FROM prod) SELECT product_key, product_name AS title, {CLIP('long', 60)} AS seo_title, {CLIP('long || long || long', 155)} AS meta_description, product_name AS image_alt_text, brand || ',New' AS tags, trim(regexp_replace(lower(product_name), '[^a-z0-9]+', '-', 'g'), '-') AS handle, 'v2' AS content_version FROM c")
def pb3_content_fields(spark, d):
    p = products(spark, d)
    long = F.concat("product_name", F.lit(", "), "category", F.lit(". "), "product_name")
    said = F.struct(F.col("product_name").alias("title"), long.alias("seo_title"), F.concat(long, long, long).alias("meta_description"), F.array(F.upper("brand"), F.lit("New"), F.lit("new")).alias("tags"))
    out = publish.content_fields(p.select("product_key", "product_name", F.array("brand").alias("tags"), F.to_json(said).alias("content")), "v2")
    return out.select("product_key", "title", "seo_title", "meta_description", "image_alt_text", F.array_join("tags", ",").alias("tags"), "handle", "content_version")


@query("SELECT doc_id FROM documents WHERE CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'v' || (doc_id % 2) END IS DISTINCT FROM 'v1'")
def pb4_pending_content(spark, d):
    v = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("v"), (F.col("doc_id") % 2).cast("string")))
    return publish.pending_content(read_table(spark, d, "documents").withColumn("content_version", v), "v1").select("doc_id")


@query("SELECT doc_id, CASE WHEN quality = 1 AND doc_id % 2 = 0 AND toxic = 0 THEN 'Ready' WHEN quality = 1 AND doc_id % 2 = 0 THEN 'QA Failed' WHEN quality = 1 THEN 'Content Done' WHEN doc_id % 2 = 0 THEN 'Image Done' ELSE 'Not Started' END AS status FROM labels")
def pb5_prep_status(spark, d):
    s = publish.prep_status(F.col("quality") == 1, F.col("doc_id") % 2 == 0, F.col("toxic") == 0, F.lit(False))
    return read_table(spark, d, "labels").select("doc_id", s.alias("status"))


def _listings(spark, d):
    """Rows with codes, and listings derived from part: every third has a barcode, every fifth the same SKU twice."""
    k = F.col("p_partkey")
    key = F.concat(F.lit("pid:"), k.cast("string")).alias("product_key")
    p = read_table(spark, d, "part")
    code = lambda c, pre: F.concat(F.lit(pre), c.cast("string"))
    rows = p.select(key, "p_partkey", "p_name", "p_brand", F.array(F.struct(F.when(k % 3 == 0, code(k, " B")).alias("barcode"), code(k, "S").alias("sku"))).alias("codes"))
    first = p.where(k % 7 != 0).select(k.alias("listing_id"), code(k, "b").alias("barcode"), code(k, "s").alias("sku"))
    return rows, first.unionByName(p.where(k % 5 == 0).select((k + 1_000_000_000).alias("listing_id"), F.lit(None).cast("string").alias("barcode"), code(k, "S").alias("sku")))


MATCH_SQL = "first AS (SELECT p_partkey AS k, p_partkey AS listing_id, true AS bar FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, p_partkey + 1000000000, false FROM part WHERE p_partkey % 5 = 0), hit AS (SELECT k, listing_id, 'barcode' AS matched_by FROM first WHERE bar AND k % 3 = 0), matched AS (SELECT * FROM hit UNION ALL SELECT k, listing_id, 'sku' FROM first WHERE k NOT IN (SELECT k FROM hit))"


@query(f"WITH {MATCH_SQL} SELECT 'pid:' || k AS product_key, listing_id, matched_by FROM matched")
def jn7_match_listings(spark, d):
    return publish.match_listings(*_listings(spark, d))


@query(f"WITH {MATCH_SQL} SELECT 'pid:' || p_partkey AS product_key, listing_id, CASE WHEN listing_id IS NULL THEN 'not-imported' ELSE 'would-push' END AS action, CASE WHEN listing_id IS NULL THEN '' WHEN p_partkey % 2 = 0 THEN 'title,tags,image' ELSE 'title,tags' END AS fields FROM part LEFT JOIN matched ON k = p_partkey")
def pb6_push_plan(spark, d):
    rows, listings = _listings(spark, d)
    plan = rows.select("product_key", F.col("p_name").alias("title"), F.lit(None).cast("string").alias("description_html"), F.array("p_brand").alias("tags"), F.lit("https://img").alias("image"), F.col("p_name").alias("image_alt_text"), F.when(F.col("p_partkey") % 2 == 1, F.array("p_name")).alias("alts"))
    out = publish.push_plan(plan, publish.match_listings(rows, listings))
    return out.select("product_key", "listing_id", "action", F.array_join("fields", ",").alias("fields"))


@query(f"WITH {SUPPLIERS} SELECT supplier_key, supplier_name FROM sup WHERE supplier_name ILIKE '%7%'")
def jn3_semi_supplier(spark, d):
    s = suppliers(spark, d)
    return insight.semi_supplier(s.select("supplier_key", F.col("supplier_name").alias("n")), s, "7").select("supplier_key", F.col("n").alias("supplier_name"))


BARE = JOB.replace("prod LEFT JOIN scored USING (supplier_key)", "prod LEFT JOIN (SELECT * FROM scored WHERE false) USING (supplier_key)")
# the 120 best of the first ranking, at most four of a supplier, with what their details say
PICKED = f"""pre AS (WITH {BARE} SELECT product_key, supplier_key, product_score, status FROM classed),
picked AS (SELECT product_key FROM (SELECT *, row_number() OVER (PARTITION BY supplier_key ORDER BY product_score DESC, product_key) AS r FROM pre WHERE status = 'Shortlisted') WHERE r <= 4 ORDER BY product_score DESC, product_key LIMIT 120)"""
ENRICHED = JOB.replace("FROM prod LEFT JOIN scored", "FROM (SELECT prod.* REPLACE (CASE WHEN product_key IN (SELECT product_key FROM picked) THEN 3 ELSE shipping_max_days END AS shipping_max_days) FROM prod) prod LEFT JOIN scored")


@query(f"WITH {PICKED}, fin AS (WITH {ENRICHED} SELECT status, selection_status FROM classed) SELECT 'scanned' AS stage, count(*) AS n FROM pre UNION ALL SELECT 'preranked', count(*) FROM pre WHERE status = 'Shortlisted' UNION ALL SELECT 'enriched', count(*) FROM picked UNION ALL SELECT 'shortlisted', count(*) FROM fin WHERE status = 'Shortlisted' UNION ALL SELECT 'candidates', count(*) FROM fin WHERE status IN ('Shortlisted', 'Manually Approved', 'Enriched') AND selection_status = 'Not Selected'")
def ps6_funnel_counts(spark, d):
    return funnel.counts(_funnel(spark, d)[1])


@query()
def ps6_funnel(spark, d):
    """The assortment at the funnel's end; greedy, so tests hold it against a loop."""
    pool, _ = _funnel(spark, d)
    return select_assortment(pool, C.Selection())[0]


def _funnel(spark, d):
    p = products(spark, d)
    details = p.select("product_key", F.lit(3).alias("shipping_max_days"))
    return funnel.run(p, suppliers(spark, d), details, ["shipping_max_days"], CFG)
