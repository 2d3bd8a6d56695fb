"""Landed pages, caps, resume, exports, patches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.plans.base import query
from souk.session import scratch
from souk.sources import export, pages, ranges
from souk.sources.pages import read_table


@query("SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1)::INT AS pos, l_partkey::VARCHAR AS part, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem")
def sc2_explode_response(spark, d):
    """An order's lines as one JSON response each."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(x["l_partkey"].alias("ID")))
    body = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(lines.alias("result"), F.count("*").alias("total"))).alias("raw"))
    out = pages.explode_response(body, "raw", "result", "total")
    return out.select("l_orderkey", "pos", F.get_json_object("product", "$.ID").alias("part"), "total")


LANDED = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def _landed_orders(spark, d):
    """Orders landed as page files, a JSON list each."""
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.floor(F.col("o_orderkey") / 1000).alias("p"))
    where = scratch(spark)
    files = o.groupBy("p").agg(F.to_json(F.collect_list(F.struct("id", "name"))).alias("value"))
    files.select("value", "p").repartition("p").write.partitionBy("p").text(where)
    return f"{where}/*"


def _as_orders(got):
    return got.select(F.col("id").alias("o_orderkey"), (F.regexp_extract("file", "p=([0-9]+)", 1).cast("int") + F.col("page_no")).cast("int").alias("page_no"), "name")


ORDER_PAGES = "SELECT o_orderkey, (o_orderkey // 1000 + 1)::INT AS page_no, o_orderpriority AS name FROM orders WHERE o_orderkey >= 0"


@query(ORDER_PAGES)
def sc1_read_pages(spark, d):
    return _as_orders(pages.read_pages(spark, _landed_orders(spark, d), LANDED))


@query(ORDER_PAGES)
def sc1_read_large_pages(spark, d):
    """The same files by byte ranges."""
    return _as_orders(ranges.read_large_pages(spark, _landed_orders(spark, d), LANDED))


@query("SELECT 'b' || s_suppkey AS \"Batch ID\", count(*)::VARCHAR AS \"Total\", 'now' AS \"Exported At\" FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def sc13_export_batches(spark, d):
    b = read_table(spark, d, "lineitem").groupBy(F.concat(F.lit("b"), F.col("l_suppkey").cast("string")).alias("Batch ID")).agg(F.count("*").alias("Total"))
    return export.export_batches(b, ["Batch ID", "Total"], "now")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r <= 5")
def sc3_limit_per_group(spark, d):
    l = read_table(spark, d, "lineitem")
    return pages.limit_per_group(l, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"], 5).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("WITH p AS (SELECT *, event_id // 100 AS page FROM events), s AS (SELECT event_type, page, count(*) AS n FROM p GROUP BY ALL), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s) SELECT event_id FROM p JOIN c USING (event_type, page) WHERE b < 150")
def sc3_limit_by_page(spark, d):
    e = read_table(spark, d, "events").withColumn("page", F.floor(F.col("event_id") / 100))
    return pages.limit_per_group(e, "event_type", [], 150, "page").select("event_id")


@query("SELECT event_id FROM events WHERE (event_id // 100) * 100 < 6000")
def sc4_cap_offset(spark, d):
    return pages.cap_offset(read_table(spark, d, "events").withColumn("page", F.floor(F.col("event_id") / 100) + 1), "page", 100, 6000).select("event_id")


@query("SELECT event_id, true AS partial FROM events ORDER BY ts, event_id LIMIT 500")
def sc5_limited(spark, d):
    out, partial = pages.limited(read_table(spark, d, "events"), ["ts", "event_id"], 500)
    return out.select("event_id", F.lit(partial).alias("partial"))


@query("SELECT event_id FROM events WHERE date_trunc('hour', ts) > TIMESTAMP '2024-01-10 05:00:00'")
def sc6_after_checkpoint(spark, d):
    e = read_table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts")).withColumn("cursor", F.date_format("hour", "yyyyMMddHH"))
    return pages.after_checkpoint(e, "hour", "cursor", "2024011005").select("event_id")


@query("WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS r FROM p) SELECT page_id, host, 'repeated cursor' AS violation FROM r WHERE r > 1 UNION ALL SELECT page_id, host, 'page limit' FROM p WHERE page_id > 200")
def sc7_page_log(spark, d):
    p = read_table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    return pages.page_log_check(p, "page_id", "host", 200)


@query("SELECT 'one:' || s_suppkey AS key, s_name AS name, 'one' AS source_label, NULL AS segment FROM supplier UNION ALL SELECT 'two:' || c_custkey, c_name, 'two', c_mktsegment FROM customer")
def sc8_union_sources(spark, d):
    s = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return pages.union_sources(pages.tag_source(s, "one", "one", "key"), pages.tag_source(c, "two", "two", "key"))


@query("SELECT count(*) AS n, count(DISTINCT p_partkey) AS keys FROM part")
def sc9_read_table(spark, d):
    return read_table(spark, d, "part").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("keys"))


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN p_brand || '; ' || p_type ELSE '' END AS tags, 'now' AS \"Exported At\" FROM part")
def sc10_export_frame(spark, d):
    p = read_table(spark, d, "part").withColumn("tags", F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_type")))
    return export.export_frame(p, ["p_partkey", "p_name", "tags"], "now")


@query("SELECT 'now' AS exported_at, count(*) AS count FROM part")
def sc11_json_manifest(spark, d):
    return export.manifest(read_table(spark, d, "part"), "now")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P')")
def sc12_candidates(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "Selected").when(F.col("o_orderstatus") == "P", "Pinned").otherwise("Archived")
    return export.candidates(read_table(spark, d, "orders").withColumn("selection_status", s)).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice::DECIMAL(18,6), 1)::DECIMAL(18,1) AS l_extendedprice, round_even(l_discount::DECIMAL(18,6), 1)::DECIMAL(18,1) AS l_discount FROM lineitem")
def sc14_decimals(spark, d):
    l = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount")
    return pages.conform_decimals(l, {"l_extendedprice": 1, "l_discount": 1})


@query("SELECT o_orderkey, o_orderstatus AS status, o_custkey::VARCHAR AS owners, o_totalprice AS price FROM orders")
def sc15_flatten(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", F.struct(F.lit(1).alias("id"), F.col("o_orderstatus").alias("value")).alias("status"), F.array(F.struct(F.col("o_custkey").alias("id"), F.lit("x").alias("value"))).alias("owners"), F.col("o_totalprice").cast("string").alias("price"))
    return pages.flatten_rows(o, ("price",)).select("o_orderkey", "status", F.array_join("owners", ",").alias("owners"), "price")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 THEN 'X' END, o_orderstatus) AS kept, CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 8 <> 0 THEN 'X' END ELSE o_orderstatus END AS overwritten FROM orders")
def sc16_patch(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    u = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 8 != 0, "X").alias("s"))
    a = pages.patch(o, u, "o_orderkey", "keep").withColumnRenamed("s", "kept")
    b = pages.patch(o, u, "o_orderkey", "overwrite").withColumnRenamed("s", "overwritten")
    return a.join(b, "o_orderkey")
