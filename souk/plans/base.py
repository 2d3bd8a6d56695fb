"""Registration, and the given tables in the catalogue's shape (with the same shape in SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.sources.pages import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    """supplier, nation, region and the number of parts each supplies."""
    s, n, r, l = (read_table(spark, d, t) for t in ("supplier", "nation", "region", "lineitem"))
    parts = l.select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey").agg(F.count("*").alias("parts"))
    k = F.col("s_suppkey")
    out = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(parts, k == F.col("l_suppkey"), "left")
    return out.select(
        F.concat(F.lit("sid:"), k.cast("string")).alias("supplier_key"),
        F.col("s_name").alias("supplier_name"),
        F.col("n_name").alias("location_country"),
        F.when(k % 4 != 0, F.array("r_name", F.lit("EUROPE"))).otherwise(F.array("r_name")).alias("ships_to_countries"),
        F.when(k % 5 == 0, F.array("r_name")).alias("dispatch_countries"),
        F.when(k % 10 != 0, k % 20).cast("int").alias("shipping_max_days"),
        F.when(k % 8 != 0, k % 6).cast("double").alias("supplier_rating"),
        (k % 30).cast("int").alias("review_count"),
        F.coalesce("parts", F.lit(0)).alias("relevant_product_count"),
        ((k * 13) % 101).cast("double").alias("data_completeness_pct"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("shipping_policy_available"),
        F.when(k % 2 == 0, True).alias("return_policy_available"),
        (k % 9 == 0).alias("approval_required"),
        (k % 17 != 0).alias("active"),
        F.when(k % 23 == 0, "Block").when(k % 29 == 0, "Approve").otherwise("None").alias("manual_override"),
    )


SUPPLIERS = """
sup AS (SELECT 'sid:' || s_suppkey AS supplier_key, s_name AS supplier_name, n_name AS location_country,
  CASE WHEN s_suppkey % 4 <> 0 THEN [r_name, 'EUROPE'] ELSE [r_name] END AS ships_to_countries,
  CASE WHEN s_suppkey % 5 = 0 THEN [r_name] END AS dispatch_countries,
  CASE WHEN s_suppkey % 10 <> 0 THEN (s_suppkey % 20)::INT END AS shipping_max_days,
  CASE WHEN s_suppkey % 8 <> 0 THEN (s_suppkey % 6)::DOUBLE END AS supplier_rating,
  (s_suppkey % 30)::INT AS review_count, coalesce(parts, 0) AS relevant_product_count,
  ((s_suppkey * 13) % 101)::DOUBLE AS data_completeness_pct,
  CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS shipping_policy_available,
  CASE WHEN s_suppkey % 2 = 0 THEN true END AS return_policy_available,
  s_suppkey % 9 = 0 AS approval_required, s_suppkey % 17 <> 0 AS active,
  CASE WHEN s_suppkey % 23 = 0 THEN 'Block' WHEN s_suppkey % 29 = 0 THEN 'Approve' ELSE 'None' END AS manual_override
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey)
"""

KITCHENWARE = ("grater", "tumbler", "cushion", "bath mat", "tool", "glass jar", "soap", "lamp with battery")


def products(spark: SparkSession, d: str) -> DataFrame:
    """part, with the cheapest offer and the first supplier that lineitem has for it."""
    p, l = read_table(spark, d, "part"), read_table(spark, d, "lineitem")
    offers = l.groupBy("l_partkey").agg(F.min((F.col("l_extendedprice") / (F.col("l_quantity") * 4)).cast("decimal(18,8)")).alias("cost"), F.min("l_suppkey").alias("s"))
    k = F.col("p_partkey")
    images = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < k % 4), lambda i: F.concat(F.lit("https://img/"), k.cast("string"), F.lit("-"), i.cast("string")))
    noun = F.element_at(F.array(*map(F.lit, KITCHENWARE)), (k % len(KITCHENWARE) + 1).cast("int"))
    return p.join(offers, k == F.col("l_partkey"), "left").select(
        F.concat(F.lit("pid:"), k.cast("string")).alias("product_key"),
        F.concat(F.lit("sid:"), F.col("s").cast("string")).alias("supplier_key"),
        F.concat_ws(" ", "p_name", noun).alias("product_name"),
        F.when(k % 6 != 0, F.concat(F.lit("an easy way to save time with this "), noun)).alias("description"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.when(k % 9 == 0, "Home decor").alias("subcategory"),
        F.element_at(F.array(*map(F.lit, ("EUR", "USD", "GBP", "XXX"))), (k % 4 + 1).cast("int")).alias("currency"),
        F.when(k % 31 != 0, F.col("cost")).alias("supplier_price"),
        F.when(k % 2 == 0, F.lit("5.50").cast("decimal(18,4)")).alias("shipping_cost"),
        (k % 4 == 0).alias("shipping_cost_known"),
        F.when(k % 37 != 0, F.col("p_retailprice").cast("decimal(18,4)")).alias("suggested_retail_price"),
        F.when(k % 3 != 0, F.col("p_size") % 20).cast("int").alias("shipping_max_days"),
        F.when(k % 5 != 0, k % 50).cast("int").alias("stock_quantity"),
        F.when(k % 11 == 0, "Out of stock").alias("stock_status"),
        images.alias("image_urls"),
        F.try_element_at(images, F.lit(1)).alias("main_image_url"),
        (k % 41 != 0).alias("active"),
        F.when(k % 43 == 0, "Manually Approved").when(k % 47 == 0, "Manually Rejected").otherwise("Unscored").alias("review_status"),
        F.when(k % 53 == 0, "Selected").otherwise("Not Selected").alias("selection_status"),
        (k % 2 == 1).alias("is_new"),
        F.when(k % 7 == 0, F.lit("2024-01-01").cast("timestamp")).alias("enriched_at"),
    )


PRODUCTS = f"""
offers AS (SELECT l_partkey, min((l_extendedprice / (l_quantity * 4))::DECIMAL(18,8)) AS cost, min(l_suppkey) AS s FROM lineitem GROUP BY 1),
prod0 AS (SELECT *, {list(KITCHENWARE)}[(p_partkey % {len(KITCHENWARE)} + 1)::INT] AS noun,
  list_transform(range(0, p_partkey % 4), lambda i: 'https://img/' || p_partkey || '-' || i) AS img FROM part LEFT JOIN offers ON p_partkey = l_partkey),
prod AS (SELECT 'pid:' || p_partkey AS product_key, 'sid:' || s AS supplier_key, p_name || ' ' || noun AS product_name,
  CASE WHEN p_partkey % 6 <> 0 THEN 'an easy way to save time with this ' || noun END AS description,
  p_brand AS brand, p_type AS category, CASE WHEN p_partkey % 9 = 0 THEN 'Home decor' END AS subcategory,
  ['EUR', 'USD', 'GBP', 'XXX'][(p_partkey % 4 + 1)::INT] AS currency,
  CASE WHEN p_partkey % 31 <> 0 THEN cost END AS supplier_price,
  CASE WHEN p_partkey % 2 = 0 THEN 5.50::DECIMAL(18,4) END AS shipping_cost, p_partkey % 4 = 0 AS shipping_cost_known,
  CASE WHEN p_partkey % 37 <> 0 THEN p_retailprice::DECIMAL(18,4) END AS suggested_retail_price,
  CASE WHEN p_partkey % 3 <> 0 THEN (p_size % 20)::INT END AS shipping_max_days,
  CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 50)::INT END AS stock_quantity,
  CASE WHEN p_partkey % 11 = 0 THEN 'Out of stock' END AS stock_status, img AS image_urls, img[1] AS main_image_url,
  p_partkey % 41 <> 0 AS active,
  CASE WHEN p_partkey % 43 = 0 THEN 'Manually Approved' WHEN p_partkey % 47 = 0 THEN 'Manually Rejected' ELSE 'Unscored' END AS review_status,
  CASE WHEN p_partkey % 53 = 0 THEN 'Selected' ELSE 'Not Selected' END AS selection_status, p_partkey % 2 = 1 AS is_new,
  CASE WHEN p_partkey % 7 = 0 THEN TIMESTAMP '2024-01-01' END AS enriched_at FROM prod0)
""".replace("\n", " ")


def offers(spark: SparkSession, d: str) -> DataFrame:
    """A row per lineitem: cost, retail price and shipping of a part as one supplier sells it."""
    l, p = read_table(spark, d, "lineitem"), read_table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "p_type",
        (F.col("l_extendedprice") / (F.col("l_quantity") * 10)).cast("decimal(18,8)").alias("supplier_price"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount") * 100).cast("decimal(18,4)").alias("shipping_cost"),
        (F.col("l_linenumber") % 2 == 0).alias("shipping_cost_known"),
        F.when(F.col("l_partkey") % 13 != 0, F.col("p_retailprice")).cast("decimal(18,4)").alias("suggested_retail_price"),
    )


OFFERS = """
offer AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_type,
  (l_extendedprice / (l_quantity * 10))::DECIMAL(18,8) AS supplier_price,
  CASE WHEN l_linenumber % 2 = 0 THEN (l_discount * 100)::DECIMAL(18,4) END AS shipping_cost, l_linenumber % 2 = 0 AS shipping_cost_known,
  CASE WHEN l_partkey % 13 <> 0 THEN p_retailprice::DECIMAL(18,4) END AS suggested_retail_price
 FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


def margin_sql(source: str, mode: str = "rrp", target: float = 55, markup: float = 3.0, keep: str = "*") -> str:
    """CTEs m1..m3 over a CTE that has the price columns; m3 has the margin columns."""
    ask = {"rrp": "mk", "target_margin": f"base / (1 - 0.1 - {target} / 100.0::DOUBLE)", "markup": f"base * {markup}::DOUBLE / (1 - {markup} * 0.1::DOUBLE)"}[mode]
    return f"""
m1 AS (SELECT *, shipping_cost_known AND shipping_cost IS NOT NULL AS known, CASE WHEN suggested_retail_price > 0 THEN suggested_retail_price::DOUBLE END AS mk,
  supplier_price::DOUBLE + (CASE WHEN shipping_cost_known AND shipping_cost IS NOT NULL THEN shipping_cost ELSE round_even((supplier_price * 15 / 100)::DECIMAL(18,6), 2) END)::DOUBLE AS base FROM {source}),
m2 AS (SELECT *, CASE WHEN base IS NOT NULL AND mk IS NOT NULL THEN {ask} END AS ask FROM m1),
m2b AS (SELECT *, round_even((base + ask * 0.1::DOUBLE)::DECIMAL(18,6), 2)::DECIMAL(18,2) AS landed_cost FROM m2),
m2c AS (SELECT *, round_even((ask::DECIMAL(18,6) - landed_cost)::DECIMAL(18,6), 2)::DECIMAL(18,2) AS margin_amount FROM m2b),
m3 AS (SELECT *, round_even((margin_amount::DOUBLE / ask * 100)::DECIMAL(18,6), 1)::DECIMAL(10,1) AS margin_pct, round_even(ask::DECIMAL(18,6), 2)::DECIMAL(18,2) AS retail_price,
  round_even((mk / ask)::DECIMAL(18,6), 2)::DECIMAL(18,2) AS competitiveness, coalesce(ask > 1.3 * mk, false) AS uncompetitive, NOT known AS shipping_estimated,
  round_even(((ask - mk) / mk * 100)::DECIMAL(18,6), 1)::DECIMAL(18,1) AS price_vs_market FROM m2c),
m4 AS (SELECT *, CASE WHEN ask IS NULL THEN 'Incomplete' WHEN margin_pct < 40 THEN 'Below Minimum' WHEN margin_pct >= {target} THEN 'Target Met' ELSE 'Acceptable' END AS margin_status FROM m3)
"""
