"""Whole records and stored rows, made from the given tables as sources would send them."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.operators import lifecycle
from souk.plans.base import query
from souk.session import spread, written
from souk.sources import records
from souk.sources.pages import read_table

CODES = ["ES", "FR", "DE", "IT"]


def _raw(kind, given: dict) -> F.Column:
    """A struct of a raw schema with the given fields, the others null."""
    return F.struct(*[F.coalesce(given[f.name].cast(f.dataType)).alias(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in kind])


def raw_suppliers(spark, d):
    """A supplier as its source sends it: dirty name and address, markets by code or name, words for booleans."""
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_name")
    k, text = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    one = lambda n, *values: F.get(F.array(*[F.lit(v) for v in values]), k % n)
    given = {
        "id": F.when(k % 5 != 0, F.concat(F.lit(" "), text)), "name": F.concat(F.lit("  "), "s_name", F.lit("\t\n")), "url": F.when(k % 10 != 0, F.concat(F.lit("HTTPS://Shop.Example/S/"), text, F.lit("/?utm_source=a#x"))),
        "country": one(4, "de", "Deutschland", "italia", None), "approval_required": one(3, "No", "yes", "ask"), "rating": one(3, "4,5", "3.9", None), "review_count": one(4, "12", "7.9", "", "many"),
        "catalog_count": text, "shipping_min_days": one(2, "2", None), "shipping_max_days": one(3, "6", "11.0", "soon"), "shipping_policy_available": one(3, "available", "unavailable", None),
        "return_policy_available": one(2, "1", "0"), "contact_available": one(4, "a@b", "", "true", "false"), "active": one(4, None, "active", "no", "perhaps"), "manual_override": one(7, "Approve"),
        "dispatch_countries": F.when(k % 3 == 0, F.array(F.lit("CN"))).when(k % 3 == 1, F.array().cast("array<string>")), "ships_to_countries": F.array(F.lit("es"), F.lit("Spain"), one(2, "FR", "France"), F.lit(" ")),
    }
    return s.select("s_suppkey", _raw(records.RAW_SUPPLIER, given).alias("supplier"))


SUPPLIER_SQL = """raw AS (SELECT *, s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 10 <> 0 THEN 'https://shop.example/S/' || s_suppkey END AS u, ['Germany', 'Germany', 'Italy', NULL][(s_suppkey % 4 + 1)::INT] AS c FROM supplier),
sup_record AS (SELECT s_suppkey, CASE WHEN k % 5 <> 0 THEN 'sid:' || k WHEN u IS NOT NULL THEN 'surl:' || substr(sha256(u), 1, 20) ELSE 'shash:' || substr(sha256(concat_ws('|', lower(replace(s_name, '#', '-')), lower(['de', 'Germany', 'Italy', NULL][(k % 4 + 1)::INT]))), 1, 20) END AS supplier_key,
  CASE WHEN k % 5 <> 0 THEN k::VARCHAR END AS source_supplier_id, s_name AS supplier_name, CASE WHEN k % 10 <> 0 THEN 'https://shop.example/S/' || k END AS supplier_url, c AS location_country,
  CASE WHEN k % 3 = 0 THEN 'China' ELSE '' END AS dispatch_countries, 'Spain;France' AS ships_to_countries, [false, true, NULL][(k % 3 + 1)::INT] AS approval_required, [4.5::DOUBLE, 3.9::DOUBLE, NULL][(k % 3 + 1)::INT] AS supplier_rating,
  [12, 7, NULL, NULL][(k % 4 + 1)::INT] AS review_count, k::INT AS catalog_product_count, [2, NULL][(k % 2 + 1)::INT] AS shipping_min_days, [6, 11, NULL][(k % 3 + 1)::INT] AS shipping_max_days,
  [true, false, NULL][(k % 3 + 1)::INT] AS shipping_policy_available, k % 2 = 0 AS return_policy_available, k % 4 IN (0, 2) AS contact_information_available, [true, true, false, NULL][(k % 4 + 1)::INT] AS active, CASE WHEN k % 7 = 0 THEN 'Approve' END AS manual_override,
  round_even(((1 + (k % 10 <> 0)::INT + (c IS NOT NULL)::INT + (k % 3 = 0)::INT + 1 + (k % 2 = 0)::INT + (k % 3 <> 2)::INT + (k % 3 <> 2)::INT + 1 + 1) * 10)::DECIMAL(18,6), 1)::DECIMAL(5,1) AS data_completeness_pct FROM raw)"""


@query(f"WITH {SUPPLIER_SQL} SELECT * EXCLUDE (s_suppkey) FROM sup_record")
def pj4_normalize_suppliers(spark, d):
    out = records.normalize_suppliers(raw_suppliers(spark, d))
    return out.withColumns({c: F.array_join(c, ";") for c in ("dispatch_countries", "ships_to_countries")})


def raw_products(spark, d):
    """A product as its source sends it: key ladder, prices in several spellings, zones, variants, pictures."""
    p, k = spread(read_table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "p_partkey"), F.col("p_partkey")
    text = k.cast("string")
    one = lambda n, *values: F.get(F.array(*[F.lit(v) for v in values]), k % n)
    zone = lambda cost, lo, hi, *where: F.struct(cost.alias("cost"), F.lit(lo).alias("min_days"), F.lit(hi).alias("max_days"), F.array(*map(F.lit, where)).alias("locations"))
    zones = F.when(k % 4 == 0, F.array(zone(F.lit(2.5), 3, 5, "ES", "US"), zone(k.cast("double"), 2, 9, "FR", "ES"))).when(k % 4 == 1, F.array(zone(F.lit(1.0), 1, 2, "US"))).when(k % 4 == 2, F.array(zone(F.lit(None).cast("double"), 4, 4, "DE")))
    variant = F.struct(F.concat(F.lit("V-"), text).alias("sku"), F.lit(None).cast("string").alias("id"), F.lit("Red").alias("option"), F.lit(None).cast("string").alias("title"))
    supplier = _raw(records.RAW_SUPPLIER, {"id": (k % 9 + 1).cast("string")})
    given = {
        "id": F.when(k % 3 == 0, text), "name": F.concat("p_name", F.lit("  Café"), F.when(k % 6 == 2, F.concat(F.lit(" "), text)).otherwise("")), "url": F.when(k % 3 == 1, F.concat(F.lit("https://Shop.example/p/"), text, F.lit("/?b=2&a=1&gclid=9"))), "sku": F.when(k % 6 == 5, F.concat(F.lit(" sku "), text)), "brand": F.concat(F.lit("\t"), "p_brand"),
        "category": F.col("p_type"), "description": F.concat(F.lit("<p>A&amp;B&nbsp;"), "p_name", F.lit("</p>")), "currency": F.lit("EUR "), "price": F.when(k % 5 == 0, "0").when(k % 5 == 1, "n/a").otherwise(F.concat(F.lit("EUR "), F.col("p_size").cast("string"), F.lit(",50"))), "default_currency_price": one(2, "7.25", None),
        "suggested_retail_price": F.col("p_retailprice").cast("string"), "shipping_cost": one(2, "3,00", None), "shipping_min_days": F.lit("1"), "shipping_max_days": one(2, "8", None), "stock_status": one(3, " In stock", None, "low stock"), "stock_quantity": F.col("p_size").cast("string"),
        "images": F.when(k % 2 == 0, F.array(F.concat(F.lit("https://img/"), text, F.lit("/")), F.lit(" "), F.lit("https://img/b#f"))), "main_image": F.when(k % 3 == 0, F.lit("https://img/main")), "variants": F.when(k % 2 == 1, F.array(variant)), "shipping_zones": zones,
        "added_at": F.lit("2024-05-01T10:00:00+02:00"), "updated_at": one(2, "1700000000", "bad"), "active": one(3, None, "inactive", "1"), "supplier": supplier,
    }
    return p.select("p_partkey", _raw(records.RAW_PRODUCT, given).alias("r")).select("p_partkey", "r.*")


SIGN = "CASE WHEN k % 2 = 1 THEN substr(sha256('v-' || k || '-red'), 1, 20) ELSE '' END"
PRODUCT_SQL = f"""r0 AS (SELECT *, p_partkey AS k, 'sid:' || (p_partkey % 9 + 1) AS sk, p_name || ' Café' || CASE WHEN p_partkey % 6 = 2 THEN ' ' || p_partkey ELSE '' END AS title, {SIGN} AS sig FROM (SELECT *, p_partkey AS k FROM part)),
r1 AS (SELECT *, CASE k % 4 WHEN 0 THEN true WHEN 2 THEN true ELSE false END AS zoned FROM r0),
prod_record AS (SELECT CASE WHEN k % 3 = 0 THEN 'pid:' || k WHEN k % 6 = 5 THEN 'psku:' || substr(sha256(sk || '|sku ' || k), 1, 20) WHEN k % 3 = 1 THEN 'purl:' || substr(sha256('https://shop.example/p/' || k || '?a=1&b=2'), 1, 20)
    ELSE 'phash:' || substr(sha256(concat_ws('|', sk, replace(lower(p_name), ' ', '-') || '-cafe-' || k, nullif(sig, ''))), 1, 20) END AS product_key,
  CASE WHEN k % 3 = 0 THEN k::VARCHAR END AS source_product_id, title AS product_name, CASE WHEN k % 3 = 1 THEN 'https://shop.example/p/' || k || '?a=1&b=2' END AS product_url, sk AS supplier_key, CASE WHEN k % 6 = 5 THEN 'sku ' || k END AS supplier_sku,
  p_brand AS brand, p_type AS category, NULL::VARCHAR AS subcategory, 'A&B ' || p_name AS description, 'EUR' AS currency, CASE WHEN k % 5 > 1 THEN p_size + 0.5::DOUBLE WHEN k % 2 = 0 THEN 7.25::DOUBLE END AS supplier_price, p_retailprice AS suggested_retail_price,
  CASE k % 4 WHEN 0 THEN greatest(2.5::DOUBLE, k::DOUBLE) WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE NULL END AS shipping_cost, k % 4 = 0 AS shipping_cost_known, CASE k % 4 WHEN 0 THEN 2 WHEN 2 THEN 4 ELSE 1 END AS shipping_min_days, CASE k % 4 WHEN 0 THEN 9 WHEN 2 THEN 4 END AS shipping_max_days,
  CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS target_markets_shipped, CASE WHEN k % 4 < 3 THEN 4 END AS target_markets_total, ['In stock', NULL, 'low stock'][(k % 3 + 1)::INT] AS stock_status, p_size AS stock_quantity,
  (k % 2)::INT AS variants_count, CASE WHEN sig = '' THEN '' ELSE substr(sha256('v-' || k || '-red'), 1, 20) END AS variant_signature, CASE WHEN k % 3 = 0 THEN 'https://img/main' WHEN k % 2 = 0 THEN 'https://img/' || k END AS main_image_url,
  CASE WHEN k % 2 = 0 THEN 'https://img/' || k || ';https://img/b' ELSE '' END AS image_urls, NULL::VARCHAR AS ships_from, TIMESTAMP '2024-05-01 08:00:00' AS added_at, CASE WHEN k % 2 = 0 THEN TIMESTAMP '2023-11-14 22:13:20' END AS updated_at, [true, false, true][(k % 3 + 1)::INT] AS active FROM r1)"""


@query(f"WITH {PRODUCT_SQL} SELECT * FROM prod_record")
def pj4_normalize_products(spark, d):
    out = records.normalize_products(raw_products(spark, d), CODES)
    return out.withColumns({"image_urls": F.array_join("image_urls", ";"), "added_at": F.col("added_at").cast("timestamp_ntz"), "updated_at": F.col("updated_at").cast("timestamp_ntz")})


@query(f"""WITH {PRODUCT_SQL}, a AS (SELECT *, stock_quantity % 4 = 0 AS changes, stock_quantity % 5 <> 0 AS again FROM prod_record), s AS (SELECT *, stock_quantity % 3 <> 0 AS first FROM a)
SELECT product_key, product_name, image_urls, stock_status, stock_quantity, active, shipping_cost_known, review_status, is_new, first_seen, last_seen, last_changed, last_scan_run FROM (
 SELECT product_key, product_name, nullif(replace(image_urls, ';', '|'), '') AS image_urls, CASE stock_status WHEN 'In stock' THEN 'In Stock' WHEN 'low stock' THEN 'Low Stock' ELSE 'Unknown' END AS stock_status, CASE WHEN again AND changes THEN stock_quantity + 1 ELSE stock_quantity END AS stock_quantity, active, shipping_cost_known,
  CASE WHEN first THEN 'Manual Review' ELSE 'Unscored' END AS review_status, NOT (first AND again AND changes) AS is_new, CASE WHEN first THEN 1 ELSE 2 END AS first_seen, CASE WHEN again THEN 2 ELSE 1 END AS last_seen, CASE WHEN first AND again AND changes THEN 2 END AS last_changed, CASE WHEN again THEN 'run2' ELSE 'run1' END AS last_scan_run FROM s WHERE first OR again)""")
def pj7_store_products(spark, d):
    """Two scans: what is created, changed, seen again or not seen; a person's status in between stays."""
    life, rows = lifecycle.PRODUCTS, written(records.normalize_products(raw_products(spark, d), CODES))  # both scans read it
    first, again = rows.where("stock_quantity % 3 <> 0"), rows.where("stock_quantity % 5 <> 0")
    again = again.withColumn("stock_quantity", F.col("stock_quantity") + F.when(F.col("stock_quantity") % 4 == 0, 1).otherwise(0))
    a, b = (lifecycle.store_rows(x, life) for x in (first, again))
    one = lifecycle.store(lifecycle.empty(a, life), a, life, "2024-01-01", "run1").drop("_action").withColumn("review_status", F.lit("Manual Review"))
    two = lifecycle.store(one, b, life, "2024-01-02", "run2")
    day = lambda c: F.dayofmonth(c)
    return two.select("product_key", "product_name", F.replace("image_urls", F.lit("\n"), F.lit("|")).alias("image_urls"), "stock_status", "stock_quantity", "active", "shipping_cost_known", "review_status", "is_new", day("first_seen_at").alias("first_seen"), day("last_seen_at").alias("last_seen"), day("last_changed_at").alias("last_changed"), "last_scan_run")


@query(f"WITH {SUPPLIER_SQL} SELECT supplier_key, supplier_name, replace(nullif(dispatch_countries, ''), ';', ', ') AS dispatch_countries, replace(ships_to_countries, ';', ', ') AS ships_to_countries, coalesce(active, false) AS active, data_completeness_pct, coalesce(manual_override, 'None') AS manual_override, 'Unscored' AS eligibility, supplier_rating FROM sup_record")
def pj7_store_suppliers(spark, d):
    """A first scan of every supplier."""
    life = lifecycle.SUPPLIERS
    rows = lifecycle.store_rows(records.normalize_suppliers(raw_suppliers(spark, d)), life)
    out = lifecycle.store(lifecycle.empty(rows, life), rows, life, "2024-01-01", "run1")
    return out.select("supplier_key", "supplier_name", "dispatch_countries", "ships_to_countries", "active", "data_completeness_pct", "manual_override", "eligibility", "supplier_rating")
