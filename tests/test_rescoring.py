"""Incremental rescoring against a full job over the later snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.operators import pricing, rescoring, scoring
from souk.plans import catalogue
from souk.plans.base import products, suppliers
from souk.session import written

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_equals_a_full_job_and_scores_less(spark):
    got, stale, scored = catalogue.rescored(spark, SF)
    p, s = catalogue.later(spark, SF)
    p = rescoring.with_fingerprint(p, "product_key")
    full_suppliers = scoring.score_suppliers(catalogue.counted(s, rescoring.relevant_counts(p)), catalogue.CFG)
    full = scoring.score_products(p, full_suppliers, None, catalogue.CFG).withColumn("score_version", F.lit("1"))
    assert rows(got) == rows(full)
    assert 0 < stale.count() < p.count() and 0 < scored.count() <= s.count()


def small(spark):
    p = products(spark, SF).limit(60)
    s = scoring.score_suppliers(suppliers(spark, SF), catalogue.CFG)
    return written(rescoring.with_fingerprint(p, "product_key")), written(s)


def test_what_depends_on_what(spark):
    p, s = small(spark)
    stored = written(scoring.score_products(p, s, None, catalogue.CFG).withColumn("score_version", F.lit("1")))
    none, nobody = p.limit(0).select("product_key"), s.limit(0).select("supplier_key")
    stale = lambda changed=none, moved=nobody, v="1", c=None: {r.product_key for r in rescoring.stale_products(p, stored, changed, moved, v, c).collect()}
    assert stale() == set()
    assert len(stale(v="2")) == 60
    one = p.orderBy("product_key").limit(1)
    assert stale(changed=one.select("product_key")) == {one.first().product_key}
    who = one.first().supplier_key
    assert stale(moved=s.where(F.col("supplier_key") == who).select("supplier_key")) == {r.product_key for r in p.where(F.col("supplier_key") == who).collect()}
    assert stale(c=spark.createDataFrame([("USD",)], "currency string")) == {r.product_key for r in p.where("currency = 'USD'").collect()}
    gone = stored.where("product_key <> 'x'").limit(50)
    assert len({r.product_key for r in rescoring.stale_products(p, gone, none, nobody, "1").collect()}) == 10


def test_moved_rates_and_suppliers(spark):
    a = spark.createDataFrame([("EUR", 1.0), ("USD", 0.9), ("GBP", 1.1)], "currency string, rate double")
    b = spark.createDataFrame([("EUR", 1.0), ("USD", 0.91), ("CHF", 1.0)], "currency string, rate double")
    assert {r.currency for r in rescoring.moved_rates(a, b).collect()} == {"USD", "GBP", "CHF"}
    _, s = small(spark)
    other = s.withColumn("supplier_score", F.when(F.col("supplier_key") == "sid:1", F.lit(0).cast("decimal(5,1)")).otherwise(F.col("supplier_score")))
    assert {r.supplier_key for r in rescoring.moved_suppliers(s, other).collect()} <= {"sid:1"}


def test_a_rescore_after_a_change_of_rates(spark):
    p, s = small(spark)
    old = pricing.rate_table(spark)
    new = old.withColumn("rate", F.when(F.col("currency") == "USD", 0.5).otherwise(F.col("rate")))
    stored = written(scoring.score_products(p, s, old, catalogue.CFG).withColumn("score_version", F.lit("1")))
    stale = written(rescoring.stale_products(p, stored, p.limit(0).select("product_key"), s.limit(0).select("supplier_key"), "1", rescoring.moved_rates(old, new)))
    assert stale.count() == p.where("currency = 'USD'").count()
    got = rescoring.rescore_products(p, s, stored, stale, new, catalogue.CFG, "1")
    assert rows(got) == rows(scoring.score_products(p, s, new, catalogue.CFG).withColumn("score_version", F.lit("1")))


def test_counts_follow_their_rows(spark):
    kind = "product_key string, supplier_key string, v int"
    a = rescoring.with_fingerprint(spark.createDataFrame([("1", "a", 1), ("2", "a", 1), ("3", "b", 1), ("4", None, 1), ("5", "c", 1)], kind), "product_key")
    b = rescoring.with_fingerprint(spark.createDataFrame([("1", "b", 1), ("2", "a", 9), ("4", "a", 1), ("5", "c", 1), ("6", "d", 1)], kind), "product_key")
    changed = rescoring.differing(a, b, "product_key")
    assert {(r.product_key, r.was, r.now) for r in changed.collect()} == {("1", True, True), ("2", True, True), ("3", True, False), ("4", True, True), ("6", False, True)}
    got = rescoring.shifted_counts(rescoring.relevant_counts(a), a, b, changed, "product_key")
    assert {(r.supplier_key, r.n) for r in got.collect()} == {("a", 2), ("b", 1), ("c", 1), ("d", 1)}
    assert {(r.supplier_key, r.n) for r in rescoring.relevant_counts(b).collect()} == {(r.supplier_key, r.n) for r in got.where("n > 0").collect()}
