"""Whole records: literal cases of every rule's edge, and a scan's life cycle step by step."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from souk.operators import lifecycle
from souk.plans import records as plans
from souk.session import written
from souk.sources import pages, records


def rows(spark, tmp_path, products):
    f = tmp_path / "p.json"
    f.write_text(json.dumps({"products": products}))
    return pages.read_pages(spark, str(f), records.RAW_PRODUCT)


SUPPLIER = {"id": "S10", "name": " KitchenPro Supplies ", "url": "https://x/s/10/", "country": "Deutschland", "dispatch_countries": ["Germany"], "ships_to_countries": ["Germany", "France"], "rating": "4.7", "shipping_min_days": 3, "shipping_max_days": 7, "shipping_policy_available": "yes", "return_policy_available": "no", "contact_available": True}


def test_supplier_record(spark, tmp_path):
    r = records.normalize_suppliers(rows(spark, tmp_path, [{"supplier": SUPPLIER}])).first()
    assert (r.supplier_key, r.supplier_name, r.supplier_url, r.location_country, r.supplier_rating) == ("sid:S10", "KitchenPro Supplies", "https://x/s/10", "Germany", 4.7)
    assert (r.shipping_policy_available, r.return_policy_available, r.contact_information_available, r.active) == (True, False, True, True)
    assert float(r.data_completeness_pct) == 100.0
    bare = records.normalize_suppliers(rows(spark, tmp_path, [{"supplier": {"name": "Größe & Co", "country": "FR"}}, {"supplier": {"id": ""}}])).collect()
    assert bare[0].supplier_key.startswith("shash:") and bare[0].location_country == "France" and float(bare[0].data_completeness_pct) == 20.0
    assert bare[1].supplier_key is None


def test_markets_by_code_meet_markets_by_name(spark, tmp_path):
    raw = rows(spark, tmp_path, [{"supplier": {"id": 1, "country": "CN", "ships_to_countries": ["ES", "Spain", "deutschland", "GB", "Xland"], "dispatch_countries": ["CN"]}}])
    r = records.normalize_suppliers(raw).first()
    assert r.ships_to_countries == ["Spain", "Germany", "United Kingdom", "Xland"] and r.dispatch_countries == ["China"]


PRODUCT = {"id": "P100", "name": "Garlic Press", "url": "https://x/p/100", "sku": "GP", "price": "4,50", "shipping_cost": "2,00", "images": ["https://x/a.jpg", "https://x/a.jpg"], "variants": [{"sku": "A"}], "supplier": {"id": "S1"}}


def test_product_record(spark, tmp_path):
    r = records.normalize_products(rows(spark, tmp_path, [PRODUCT])).first()
    assert (r.product_key, r.supplier_key, r.supplier_price, r.shipping_cost, r.shipping_cost_known, r.variants_count, r.main_image_url) == ("pid:P100", "sid:S1", 4.5, 2.0, True, 1, "https://x/a.jpg")
    assert r.image_urls == ["https://x/a.jpg"] * 2 and r.active is True and r.target_markets_total is None


@pytest.mark.parametrize("given,want", [({"price": 0, "default_currency_price": "3.5"}, 3.5), ({"price": 0}, None), ({"price": "x", "default_currency_price": 2}, 2.0), ({"price": 1.0, "default_currency_price": 2}, 1.0)])
def test_a_zero_price_falls_through(spark, tmp_path, given, want):
    assert records.normalize_products(rows(spark, tmp_path, [{"id": 1, **given}])).first().supplier_price == want


def test_shipping_of_the_worst_market(spark, tmp_path):
    zones = [{"cost": 2.0, "min_days": 2, "max_days": 4, "locations": ["ES", "FR"]}, {"cost": 5.0, "min_days": 3, "max_days": 9, "locations": ["DE", "ES"]}, {"cost": None, "min_days": None, "max_days": None, "locations": ["IT"]}]
    raw = rows(spark, tmp_path, [{"id": 1, "shipping_zones": zones, "shipping_cost": 1}, {"id": 2, "shipping_zones": zones[2:], "shipping_cost": 1}, {"id": 3, "shipping_zones": [{"locations": ["US"]}], "shipping_cost": 1, "shipping_max_days": 8}, {"id": 4, "shipping_cost": 1}])
    got = [(r.shipping_cost, r.shipping_cost_known, r.shipping_min_days, r.shipping_max_days, r.target_markets_shipped, r.target_markets_total) for r in records.normalize_products(raw, ["ES", "DE", "IT"]).orderBy("product_key").collect()]
    assert got == [(5.0, True, 2, 9, 3, 3), (None, False, None, None, 1, 3), (1.0, True, None, 8, 0, 3), (1.0, True, None, None, None, None)]


def test_stored_rows_through_their_life(spark, tmp_path):
    life = lifecycle.PRODUCTS
    read = lambda **more: written(lifecycle.store_rows(records.normalize_products(rows(spark, tmp_path, [{**PRODUCT, **more}])).withColumn("raw", F.lit("{}")), life))
    a = read()
    one = lifecycle.store(lifecycle.empty(a, life), a, life, "2024-01-01", "r1")
    r = one.first()
    assert (r._action, r.is_new, r.review_status, r.selection_status, r.image_urls, r.stock_status, r.raw) == ("created", True, "Unscored", "Not Selected", "https://x/a.jpg\nhttps://x/a.jpg", "Unknown", "{}")
    assert r.first_seen_at.day == r.last_seen_at.day == 1 and r.last_changed_at is None
    chosen = one.drop("_action").withColumn("selection_status", F.lit("Selected")).withColumn("source_label", F.lit("kept"))
    r = lifecycle.store(chosen, read(), life, "2024-01-02", "r2").first()
    assert (r._action, r.is_new, r.last_seen_at.day, r.last_changed_at, r.last_scan_run) == ("unchanged", True, 2, None, "r2")
    r = lifecycle.store(chosen, read(price="9"), life, "2024-01-03", "r3").first()
    assert (r._action, r.is_new, r.supplier_price, r.selection_status, r.first_seen_at.day, r.last_changed_at.day, r.source_label) == ("updated", False, 9.0, "Selected", 1, 3, "kept")
    twice = read(price="9").unionByName(read(price="8"))
    assert lifecycle.store(chosen, twice, life, "2024-01-04", "r4").count() == 1


def test_product_rows_are_spread(spark, sf):
    """A table of products is one file split; their rules run in many tasks."""
    assert spark.read.parquet(f"{sf}/part.parquet").rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    assert plans.raw_products(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_two_scans_normalize_once(spark, sf):
    """Both scans of the stored products read the normalized rows as a table; none runs the rules again."""
    said = plans.pj7_store_products(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in said and "regexp_replace" not in said
