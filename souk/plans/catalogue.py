"""Scoring, pricing, classification and selection over the given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from souk.functions import config as C
from souk.operators import classify, pricing, rescoring, scoring, selection
from souk.plans.base import OFFERS, PRODUCTS, SUPPLIERS, margin_sql, offers, products, query, suppliers
from souk.session import spread, written
from souk.sources.pages import read_table

CFG = C.Config(markets=("EUROPE", "ASIA", "AFRICA"), dispatch_allowed=("EUROPE", "AFRICA"), supplier_gates=C.SupplierGates(require_target_market=True))

# --- suppliers

GATES_SQL = """CASE WHEN NOT active THEN ['INACTIVE'] ELSE [] END
  || CASE WHEN NOT list_has_any(ships_to_countries, ['EUROPE', 'ASIA', 'AFRICA']) THEN ['NO_TARGET_MARKET'] ELSE [] END
  || CASE WHEN shipping_max_days > 15 THEN ['SHIPPING_TOO_SLOW'] ELSE [] END
  || CASE WHEN relevant_product_count < 1 THEN ['INSUFFICIENT_RELEVANT_PRODUCTS'] ELSE [] END
  || CASE WHEN data_completeness_pct < 20 THEN ['LOW_DATA_COMPLETENESS'] ELSE [] END"""
CRITERIA = {
    "market_coverage": "len(list_intersect(list_distinct(ships_to_countries), ['EUROPE', 'ASIA', 'AFRICA'])) / 3.0::DOUBLE",
    "shipping_speed": "coalesce(greatest(0.0, least(1.0, 1 - shipping_max_days / 30.0::DOUBLE)), 0.0)",
    "dispatch_proximity": "CASE WHEN list_has_any(coalesce(dispatch_countries, []) || [location_country], ['EUROPE', 'ASIA', 'AFRICA']) THEN 1.0 ELSE 0.0 END",
    "data_completeness": "greatest(0.0, least(1.0, data_completeness_pct / 100.0::DOUBLE))",
    "return_policy": "CASE WHEN return_policy_available IS NULL THEN 0.5 WHEN return_policy_available THEN 1.0 ELSE 0.0 END",
    "shipping_policy": "CASE WHEN shipping_policy_available IS NULL THEN 0.5 WHEN shipping_policy_available THEN 1.0 ELSE 0.0 END",
    "rating": "coalesce(greatest(0.0, least(1.0, supplier_rating / 5.0::DOUBLE)) * (0.5 + 0.5 * least(1.0, review_count / 20.0::DOUBLE)), 0.5)",
    "catalog_depth": "least(1.0, relevant_product_count / 5.0::DOUBLE)",
    "low_friction": "CASE WHEN approval_required THEN 0.0 ELSE 1.0 END",
}
SCORE_SQL = "round_even((" + " + ".join(f"({CRITERIA[n]})::DECIMAL(18,8) * {int(w)}" for n, w in C.SUPPLIER_SCORING.weights.items()) + ")::DECIMAL(18,6), 1)::DECIMAL(5,1)"
SCORED = f"""{SUPPLIERS},
sc AS (SELECT *, {GATES_SQL} AS gate, {SCORE_SQL} AS supplier_score FROM sup),
scored AS (SELECT *, len(gate) = 0 AS gate_passed, CASE WHEN manual_override = 'Block' THEN 'Manually Blocked' WHEN manual_override = 'Approve' THEN 'Manually Approved'
  WHEN NOT active THEN 'Inactive' WHEN len(gate) > 0 THEN 'Gate Failed' WHEN supplier_score < 60 THEN 'Scored Rejected' WHEN supplier_score >= 75 THEN 'Approved' ELSE 'Manual Review' END AS eligibility,
  array_to_string(gate || CASE WHEN manual_override = 'Block' THEN ['MANUALLY_BLOCKED'] ELSE [] END || CASE WHEN manual_override = 'Approve' THEN ['MANUALLY_APPROVED'] ELSE [] END
  || CASE WHEN manual_override = 'None' AND len(gate) = 0 AND supplier_score < 60 THEN ['LOW_SUPPLIER_SCORE'] ELSE [] END
  || CASE WHEN manual_override = 'None' AND len(gate) = 0 AND approval_required THEN ['APPROVAL_REQUIRED'] ELSE [] END, ', ') AS reasons FROM sc)
"""


@query(f"WITH {SUPPLIERS} SELECT supplier_key, array_to_string({GATES_SQL}, ', ') AS reasons, len({GATES_SQL}) = 0 AS passed FROM sup")
def sg1_supplier_gates(spark, d):
    g = scoring.supplier_gates(CFG)
    return suppliers(spark, d).select("supplier_key", scoring.encode_reasons(g).alias("reasons"), (F.size(g) == 0).alias("passed"))


@query(f"WITH {SUPPLIERS} SELECT supplier_key, " + ", ".join(f"({v})::DECIMAL(18,6) AS {k}" for k, v in CRITERIA.items()) + " FROM sup")
def sg2_supplier_criteria(spark, d):
    return suppliers(spark, d).select("supplier_key", *[v.cast("decimal(18,6)").alias(k) for k, v in scoring.supplier_criteria(CFG).items()])


@query(f"WITH {SUPPLIERS} SELECT supplier_key, {SCORE_SQL} AS supplier_score FROM sup")
def sg3_weighted_score(spark, d):
    return suppliers(spark, d).select("supplier_key", scoring.weighted_score(scoring.supplier_criteria(CFG), C.SUPPLIER_SCORING.weights).alias("supplier_score"))


@query(f"WITH {SCORED} SELECT supplier_key, supplier_score, gate_passed, eligibility, reasons FROM scored")
def sg4_supplier_eligibility(spark, d):
    out = scoring.score_suppliers(suppliers(spark, d), CFG)
    return out.select("supplier_key", "supplier_score", "gate_passed", "eligibility", scoring.encode_reasons(F.col("reasons")).alias("reasons"))


@query(f"WITH {SCORED} SELECT eligibility, eligibility IN ('Gate Failed', 'Scored Rejected', 'Manually Blocked', 'Inactive') AS blocks, count(*) AS n FROM scored GROUP BY ALL")
def sg5_sg6_supplier_tally(spark, d):
    out = scoring.score_suppliers(suppliers(spark, d), CFG).withColumn("blocks", scoring.blocks_products(F.col("eligibility")))
    return scoring.tally(out, "eligibility", "blocks")


# --- prices


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, ccy AS currency, coalesce(l_extendedprice * r, l_extendedprice) AS converted FROM (SELECT *, ['EUR', 'USD', 'GBP', 'XXX'][(l_partkey % 4 + 1)::INT] AS ccy FROM lineitem) LEFT JOIN (VALUES ('EUR', 1.0::DOUBLE), ('USD', 0.92::DOUBLE), ('GBP', 1.17::DOUBLE)) v(c, r) ON ccy = c")
def jn6_to_currency(spark, d):
    l = read_table(spark, d, "lineitem").withColumn("currency", F.element_at(F.array(*map(F.lit, ("EUR", "USD", "GBP", "XXX"))), (F.col("l_partkey") % 4 + 1).cast("int")))
    l = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "currency", F.col("l_extendedprice").alias("converted"))
    return pricing.to_currency(l, ["converted"], pricing.rate_table(spark))


@query("WITH r AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'cache' WHEN 1 THEN 'live' ELSE 'fallback' END AS origin, n_name AS currency, 1.0 / (n_nationkey + 1)::DOUBLE AS rate FROM nation) SELECT origin, currency, rate FROM r WHERE origin = 'live'")
def mg1_choose_rates(spark, d):
    n = read_table(spark, d, "nation")
    origin = F.when(F.col("n_nationkey") % 3 == 0, "cache").when(F.col("n_nationkey") % 3 == 1, "live").otherwise("fallback")
    r = pricing.invert(n.select(F.col("n_name").alias("currency"), (F.col("n_nationkey") + 1).cast("double").alias("rate"))).withColumnRenamed("currency", "c")
    r = r.join(n.select("n_name", origin.alias("origin")), F.col("c") == F.col("n_name")).select("origin", F.lit(0.0).alias("fetched_at"), F.col("c").alias("currency"), "rate")
    return pricing.choose_rates(r, now=1e6, max_age=86_400)


MARGINS = "landed_cost, margin_amount, margin_pct, retail_price, competitiveness, uncompetitive, shipping_estimated, margin_status, price_vs_market"
KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, supplier_price"


def _margin(spark, d, **how):
    out = pricing.margin(offers(spark, d), replace(CFG.margin, **how))
    return out.select(*KEYS.split(", "), *MARGINS.split(", "))


@query(f"WITH {OFFERS}, {margin_sql('offer')} SELECT {KEYS}, {MARGINS} FROM m4")
def mg2_mg3_margin_rrp(spark, d):
    return _margin(spark, d)


@query(f"WITH {OFFERS}, {margin_sql('offer', 'target_margin')} SELECT {KEYS}, {MARGINS} FROM m4")
def mg2_margin_target(spark, d):
    return _margin(spark, d, mode="target_margin")


@query(f"WITH {OFFERS}, {margin_sql('offer', 'markup')} SELECT {KEYS}, {MARGINS} FROM m4")
def mg2_margin_markup(spark, d):
    return _margin(spark, d, mode="markup")


GRID = [("rrp", 55.0, 3.0, 40.0), ("target_margin", 50.0, 3.0, 45.0), ("markup", 55.0, 2.5, 50.0)]


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {OFFERS}, {margin_sql('offer', m, t, k)} SELECT '{m}' AS mode, {t}::DOUBLE AS target, {k}::DOUBLE AS markup, {lo}::DOUBLE AS minimum, count(*) FILTER (margin_pct >= {lo}) AS sellable, count(*) FILTER (uncompetitive) AS uncompetitive, count(*) AS products FROM m4)" for m, t, k, lo in GRID))
def ps4_what_if(spark, d):
    return pricing.what_if(offers(spark, d), GRID, CFG.margin)


# --- products

SAID = "lower(product_name || ' ' || coalesce(description, '') || ' ' || category || ' ' || coalesce(subcategory, ''))"
PLAIN = [p for p in C.EXCLUDED if "(?!" not in p]
STOCK_SQL = "CASE WHEN lower(coalesce(stock_status, '')) IN ('out of stock', 'outofstock') THEN false WHEN stock_quantity IS NOT NULL THEN stock_quantity > 0 ELSE true END"
# of the words with lookaheads the given names hold soap and ring, never followed by what spares them
OUT_SQL = "regexp_matches(regexp_replace(" + SAID + r", '\bsoap\s*stand', 'stand', 'g'), '" + "|".join(f"(?:{p})" for p in PLAIN + [r"\bsoap\b", r"\bring\b"]).replace("'", "''") + "')"
PGATE_SQL = f"""CASE WHEN blocked THEN ['SUPPLIER_REJECTED'] ELSE [] END || CASE WHEN NOT active THEN ['INACTIVE'] ELSE [] END
  || CASE WHEN {OUT_SQL} THEN ['EXCLUDED_PRODUCT_TYPE'] ELSE [] END || CASE WHEN len(image_urls) = 0 THEN ['INSUFFICIENT_IMAGES'] ELSE [] END
  || CASE WHEN supplier_price IS NULL THEN ['MISSING_PRICE'] ELSE [] END || CASE WHEN NOT {STOCK_SQL} THEN ['OUT_OF_STOCK'] ELSE [] END
  || CASE WHEN shipping_max_days > 15 THEN ['SHIPPING_TOO_SLOW'] ELSE [] END"""
RISK_SQL = lambda text: " || ".join(f"CASE WHEN regexp_matches({text}, '{p}') THEN ['{f}'] ELSE [] END" for f, p in C.RISKS)
TITLE = "lower(product_name || ' ' || coalesce(description, ''))"
HITS = {n: "(" + " + ".join(f"contains(lower(t), '{w}')::INT" for w in words) + ")" for n, words in C.KEYWORDS.items()}
HINT_SQL = "CASE " + " ".join(f"WHEN contains(lower(cat), '{k}') THEN '{v}'" for k, v in C.CATEGORY_HINTS) + " END"


def classified_sql(source: str, text: str, cat: str, keys: str) -> str:
    names = list(HITS)
    return f"""
c1 AS (SELECT *, {text} AS t, {cat} AS cat FROM {source}),
c2 AS (SELECT *, {HINT_SQL} AS hint, {', '.join(f'{h} AS h{i}' for i, h in enumerate(HITS.values()))} FROM c1),
c3 AS (SELECT *, greatest(h0, h1, h2, h3) AS best, h0 + h1 + h2 + h3 AS hits FROM c2),
c4 AS (SELECT *, coalesce(hint, CASE WHEN best > 0 THEN CASE {' '.join(f"WHEN h{i} = best THEN '{n}'" for i, n in enumerate(names))} END END, '{C.CATCH_ALL}') AS collection,
  CASE WHEN hint IS NOT NULL THEN 'category-map' WHEN best > 0 THEN 'keyword' ELSE 'catch-all' END AS method,
  CASE WHEN hint IS NOT NULL THEN 0.90 WHEN best > 0 THEN round_even((0.5 + 0.5 * (best / hits::DOUBLE))::DECIMAL(18,6), 2) ELSE 0.40 END::DECIMAL(4,2) AS confidence FROM c3),
classed AS (SELECT {keys}, collection, method, confidence, method <> 'category-map' AND confidence < 0.7 AS needs_review FROM c4)
"""


PCRIT = {
    "problem_solved": f"greatest(0.0, least(1.0, 0.5 + 0.15 * len(regexp_extract_all({TITLE}, '{C.PROBLEM_WORDS}'))))",
    "margin_potential": "greatest(0.0, least(1.0, coalesce(margin_pct, 0)::DOUBLE / 55.0::DOUBLE))",
    "shipping": "coalesce(greatest(0.0, least(1.0, 1 - shipping_max_days / 30.0::DOUBLE)), 0.3)",
    "content_potential": "greatest(0.0, least(1.0, 0.3 + 0.15 * len(image_urls) + least(0.4, length(coalesce(description, '')) / 600.0::DOUBLE)))",
    "differentiation": "CASE WHEN brand <> '' THEN 0.6 ELSE 0.45 END",
    "return_risk": "CASE WHEN list_has_any(flags, ['FRAGILE_GLASS', 'COMPLEX_SIZING']) THEN 0.4 ELSE 0.9 END",
    "data_quality": "(1 + (description IS NOT NULL)::INT + (coalesce(supplier_price, 0) <> 0)::INT + (len(image_urls) > 0)::INT + 1) / 5.0::DOUBLE",
    "supplier_strength": "greatest(0.0, least(1.0, supplier_score::DOUBLE / 100.0::DOUBLE))",
}
PSCORE_SQL = "round_even((" + " + ".join(f"({PCRIT[n]})::DECIMAL(18,8) * {int(w)}" for n, w in C.PRODUCT_SCORING.weights.items()) + ")::DECIMAL(18,6), 1)::DECIMAL(5,1)"
JOB = f"""{SCORED}, {PRODUCTS},
j1 AS (SELECT prod.*, coalesce(eligibility, 'Unscored') AS supplier_eligibility, coalesce(supplier_score, 0)::DECIMAL(5,1) AS supplier_score,
  coalesce(eligibility IN ('Gate Failed', 'Scored Rejected', 'Manually Blocked', 'Inactive'), false) AS blocked FROM prod LEFT JOIN scored USING (supplier_key)),
j2 AS (SELECT *, {PGATE_SQL} AS gate, {RISK_SQL(TITLE)} AS flags FROM j1), {margin_sql('j2')},
j3 AS (SELECT *, len(gate) = 0 AS passed, CASE WHEN len(gate) = 0 THEN {PSCORE_SQL} ELSE 0 END::DECIMAL(5,1) AS product_score FROM m4),
j4 AS (SELECT *, CASE WHEN review_status LIKE 'Manually%' THEN review_status WHEN blocked THEN 'Excluded By Supplier' WHEN NOT passed THEN 'Gate Failed' WHEN margin_status = 'Below Minimum' THEN 'Scored Rejected'
   WHEN len(flags) > 0 OR margin_status = 'Incomplete' THEN 'Manual Review' WHEN product_score < 45 THEN 'Scored Rejected' WHEN product_score >= 55 THEN 'Shortlisted' ELSE 'Manual Review' END AS status,
  array_to_string(gate || CASE WHEN passed THEN
    CASE WHEN list_has_any(flags, ['HEATING', 'ELECTRICAL', 'BATTERY', 'FOOD_CONTACT', 'MEDICAL', 'TRADEMARK']) THEN ['HIGH_COMPLIANCE_RISK'] ELSE [] END
    || CASE WHEN list_has_any(flags, ['FRAGILE_GLASS', 'COMPLEX_SIZING']) THEN ['HIGH_REFUND_RISK'] ELSE [] END
    || CASE WHEN margin_status = 'Incomplete' THEN ['MARGIN_UNKNOWN'] ELSE [] END || CASE WHEN margin_status = 'Below Minimum' THEN ['LOW_MARGIN'] ELSE [] END
    || CASE WHEN shipping_estimated AND margin_status <> 'Incomplete' THEN ['MARGIN_ESTIMATED'] ELSE [] END || CASE WHEN uncompetitive THEN ['UNCOMPETITIVE_PRICE'] ELSE [] END
    || CASE WHEN margin_status NOT IN ('Below Minimum', 'Incomplete') AND len(flags) = 0 AND product_score < 45 THEN ['LOW_PRODUCT_SCORE'] ELSE [] END ELSE [] END, ', ') AS why FROM j3),
{classified_sql('j4', "product_name || ' ' || coalesce(subcategory, '') || ' ' || coalesce(description, '')", "category || ' ' || coalesce(subcategory, '')", '*')}
"""


def job(spark, d):
    return scoring.score_products(products(spark, d).repartition("product_key"), scoring.score_suppliers(suppliers(spark, d), CFG), None, CFG)


@query(f"WITH {JOB} SELECT product_key, supplier_eligibility, supplier_score, margin_pct, margin_status, product_score, status AS review_status, why AS reasons, array_to_string(flags, ',') AS risk_flags, collection, confidence FROM classed")
def ps1_ps3_score_products(spark, d):
    out = job(spark, d)
    return out.select("product_key", "supplier_eligibility", "supplier_score", "margin_pct", "margin_status", "product_score", "review_status", scoring.encode_reasons(F.col("reasons")).alias("reasons"), F.array_join("risk_flags", ",").alias("risk_flags"), "collection", "confidence")


# --- rescoring of what changed

#: The later snapshot: stock gone, suppliers changed, products gone and new; slow suppliers; relevant counts of the products there are.
LATER = PRODUCTS.replace("prod AS (", "prod_b AS (") + """, prod_n AS (SELECT *, substr(product_key, 5)::BIGINT AS k FROM prod_b),
prod_c AS (SELECT * REPLACE (CASE WHEN k % 11 = 0 THEN 0 ELSE stock_quantity END AS stock_quantity, CASE WHEN k % 13 = 0 THEN 'sid:1' ELSE supplier_key END AS supplier_key) FROM prod_n WHERE k % 17 <> 0),
prod AS (SELECT * EXCLUDE (k) FROM (SELECT * FROM prod_c UNION ALL SELECT * REPLACE ('new:' || k AS product_key) FROM prod_c WHERE k % 19 = 1)), """ + SUPPLIERS.replace("sup AS (", "sup_b AS (") + """,
sup AS (SELECT * REPLACE (CASE WHEN substr(supplier_key, 5)::BIGINT % 7 = 0 THEN 30 ELSE shipping_max_days END AS shipping_max_days, coalesce(n, 0) AS relevant_product_count) FROM sup_b LEFT JOIN (SELECT supplier_key AS sk, count(*) AS n FROM prod GROUP BY 1) ON sk = supplier_key)"""
LATER_JOB = LATER + SCORED.removeprefix(SUPPLIERS) + JOB.split(PRODUCTS)[1]
SCORE_COLUMNS = "product_key, supplier_eligibility, supplier_score, margin_pct, product_score, status AS review_status, why AS reasons, collection"


def later(spark, d):
    """Products and suppliers (without relevant counts) of the later snapshot."""
    k = F.substring("product_key", 5, 20).cast("long")
    p = products(spark, d).withColumn("_k", k).where("_k % 17 <> 0")
    p = p.withColumns({"stock_quantity": F.when(F.col("_k") % 11 == 0, 0).otherwise(F.col("stock_quantity")), "supplier_key": F.when(F.col("_k") % 13 == 0, "sid:1").otherwise(F.col("supplier_key"))})
    p = p.unionByName(p.where("_k % 19 = 1").withColumn("product_key", F.concat(F.lit("new:"), F.col("_k").cast("string")))).drop("_k")
    s = suppliers(spark, d).drop("relevant_product_count")
    return p, s.withColumn("shipping_max_days", F.when(F.substring("supplier_key", 5, 20).cast("long") % 7 == 0, 30).otherwise(F.col("shipping_max_days")))


def counted(s, counts):
    n = counts.select(F.col("supplier_key").alias("_c"), "n")
    return rescoring.with_fingerprint(s.join(n, F.col("supplier_key") == F.col("_c"), "left").withColumn("relevant_product_count", F.coalesce("n", F.lit(0))).drop("_c", "n"), "supplier_key")


def rescored(spark, d):
    """(the later snapshot's scores, stale products, rescored suppliers) from the earlier snapshot's stored results."""
    old = written(rescoring.with_fingerprint(products(spark, d), "product_key"))
    counts = rescoring.relevant_counts(old)
    old_suppliers = written(scoring.score_suppliers(counted(suppliers(spark, d).drop("relevant_product_count"), counts), CFG))
    stored = written(scoring.score_products(old, old_suppliers, None, CFG).withColumn("score_version", F.lit("1")))
    p, s = later(spark, d)
    new = written(rescoring.with_fingerprint(p, "product_key"))
    changed = written(rescoring.differing(old, new, "product_key"))
    counts = rescoring.shifted_counts(counts, old, new, changed, "product_key")
    new_suppliers, scored = rescoring.rescore_suppliers(written(counted(s, counts)), old_suppliers, CFG)
    stale = written(rescoring.stale_products(new, stored, changed, rescoring.moved_suppliers(old_suppliers, new_suppliers), "1"))
    return rescoring.rescore_products(new, new_suppliers, stored, stale, None, CFG, "1"), stale, scored


@query(f"WITH {LATER_JOB} SELECT {SCORE_COLUMNS} FROM classed")
def up20_ps3_rescore(spark, d):
    """Only stale products and suppliers are scored; the SQL scores the whole later snapshot."""
    out = rescored(spark, d)[0]
    return out.select("product_key", "supplier_eligibility", "supplier_score", "margin_pct", "product_score", "review_status", scoring.encode_reasons(F.col("reasons")).alias("reasons"), "collection")


@query(f"WITH {LATER} SELECT supplier_key, count(*) AS n FROM prod WHERE supplier_key IS NOT NULL GROUP BY 1")
def ag1_counts_kept(spark, d):
    """Relevant products per supplier of the later snapshot, from the earlier counts and the products that differ."""
    old, new = (rescoring.with_fingerprint(x, "product_key") for x in (products(spark, d), later(spark, d)[0]))
    old, new = written(old), written(new)
    changed = rescoring.differing(old, new, "product_key")
    return rescoring.shifted_counts(rescoring.relevant_counts(old), old, new, changed, "product_key").where("n > 0")


@query(f"WITH {JOB} SELECT status AS review_status, collection, count(*) AS n FROM classed GROUP BY ALL")
def ag10_product_tally(spark, d):
    return scoring.tally(job(spark, d), "review_status", "collection")


@query(f"WITH {JOB} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(why, ', ')) AS reason FROM classed WHERE why <> '') GROUP BY 1")
def ps5_reason_counts(spark, d):
    return scoring.reason_counts(job(spark, d))


@query(f"WITH {JOB} SELECT product_key, array_to_string(gate, ', ') AS reasons, len(gate) = 0 AS passed, {STOCK_SQL} AS in_stock FROM classed")
def pg1_pg5_product_gates(spark, d):
    p = scoring.with_supplier(products(spark, d), scoring.score_suppliers(suppliers(spark, d), CFG))
    g = scoring.product_gates(CFG, ~scoring.blocks_products(F.col("supplier_eligibility")))
    return p.select("product_key", scoring.encode_reasons(g).alias("reasons"), (F.size(g) == 0).alias("passed"), scoring.in_stock().alias("in_stock"))


@query(f"WITH {SCORED}, {PRODUCTS} SELECT product_key, coalesce(eligibility, 'Unscored') AS supplier_eligibility, coalesce(supplier_score, 0)::DECIMAL(5,1) AS supplier_score FROM prod LEFT JOIN scored USING (supplier_key)")
def jn1_with_supplier(spark, d):
    return scoring.with_supplier(products(spark, d), scoring.score_suppliers(suppliers(spark, d), CFG)).select("product_key", "supplier_eligibility", "supplier_score")


def _texts(spark, d):
    """Every document's text, over all cores: the given file may be one split."""
    return spread(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id")


@query()
def pg2_scope_exclusion(spark, d):
    """Lookaheads, which DuckDB's patterns lack; tests hold it against Python's."""
    return _texts(spark, d).select("doc_id", scoring.is_excluded(F.lower("text")).alias("excluded"))


@query("SELECT doc_id, regexp_matches(translate(lower(text), chr(10), ' '), '" + "|".join(f"(?:{p})" for p in PLAIN if "é" not in p and "\\w*" not in p) + "') AS excluded FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM documents)")
def pg2_scope_exclusion_plain(spark, d):
    t = F.translate(F.lower(F.regexp_replace("text", r"[^\x00-\x7F]", "x")), "\n", " ")
    return _texts(spark, d).select("doc_id", scoring.is_excluded(t, tuple(p for p in PLAIN if "é" not in p and "\\w*" not in p)).alias("excluded"))


# word boundaries that know all letters, as RE2 has none
WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
WIDE_RISKS = " || ".join(f"CASE WHEN regexp_matches(t, '{p.replace(chr(92) + 'b(', f'(?:^|[^{WORD}])(', 1).replace(')' + chr(92) + 'b', f')(?:$|[^{WORD}])')}') THEN ['{f}'] ELSE [] END" for f, p in C.RISKS)


@query("WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), f AS (SELECT doc_id, " + WIDE_RISKS + " AS flags FROM t) SELECT doc_id, array_to_string(flags, ',') AS flags, array_to_string(CASE WHEN list_has_any(flags, ['HEATING', 'ELECTRICAL', 'BATTERY', 'FOOD_CONTACT', 'MEDICAL', 'TRADEMARK']) THEN ['HIGH_COMPLIANCE_RISK'] ELSE [] END || CASE WHEN list_has_any(flags, ['FRAGILE_GLASS', 'COMPLEX_SIZING']) THEN ['HIGH_REFUND_RISK'] ELSE [] END, ',') AS reasons FROM f")
def pg3_pg4_risks(spark, d):
    low = read_table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    out = low.select("doc_id", scoring.risk_flags("low").alias("f"))
    return out.select("doc_id", F.array_join("f", ",").alias("flags"), F.array_join(scoring.risk_reasons(F.col("f")), ",").alias("reasons"))


# --- classification


@query(f"WITH {PRODUCTS}, {classified_sql('prod', 'product_name || chr(32) || coalesce(subcategory, chr(0)) || chr(32) || coalesce(description, chr(0))', 'category || chr(32) || coalesce(subcategory, chr(0))', 'product_key')} SELECT * FROM classed".replace("chr(0)", "''"))
def cl1_cl4_classify(spark, d):
    return classify.classify(products(spark, d), CFG).select("product_key", "collection", "method", "confidence", "needs_review")


MAPPED = f"WITH {PRODUCTS}, {classified_sql('prod', 'product_name || chr(32) || coalesce(subcategory, chr(0)) || chr(32) || coalesce(description, chr(0))', 'category || chr(32) || coalesce(subcategory, chr(0))', 'product_key, subcategory')}".replace("chr(0)", "''")


@query(MAPPED + " SELECT product_key, CASE WHEN subcategory = 'Home decor' THEN 'Bathroom' ELSE collection END AS collection, CASE WHEN subcategory = 'Home decor' THEN 'subcategory-map' ELSE method END AS method, CASE WHEN subcategory = 'Home decor' THEN 0.95 ELSE confidence END::DECIMAL(4,2) AS confidence FROM classed")
def cl1_subcategory_map(spark, d):
    return classify.classify(products(spark, d), CFG, {"Home decor": C.BATHROOM, "Nothing": C.DINING}).select("product_key", "collection", "method", "confidence")


DOCS_CLASSED = classified_sql("documents", "text", "''", "doc_id, text")


@query(f"WITH {DOCS_CLASSED} SELECT doc_id, collection, method, confidence, needs_review FROM classed")
def cl3_keywords(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", F.lit("").alias("product_name"), F.lit("").alias("category"), F.lit("").alias("subcategory"), F.col("text").alias("description"))
    return classify.classify(docs, CFG).select("doc_id", "collection", "method", "confidence", "needs_review")


@query(f"WITH {DOCS_CLASSED}, a AS (SELECT sha256(text) AS h FROM documents WHERE doc_id % 5 = 0) SELECT doc_id, sha256(text) || ':m:v1' AS cache_key FROM classed WHERE needs_review AND sha256(text) NOT IN (SELECT h FROM a)")
def cl5_pending(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", F.lit("").alias("product_name"), F.lit("").alias("category"), F.lit("").alias("subcategory"), F.col("text").alias("description"), F.sha2("text", 256).alias("mark"))
    cache = docs.where("doc_id % 5 = 0").select(classify.cache_key(F.col("mark"), "m", "v1").alias("cache_key"))
    return classify.pending(classify.classify(docs, CFG), cache, "mark", "m", "v1").select("doc_id", "cache_key")


# --- ranking and selection


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, k) AS r FROM (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_quantity::INT AS k FROM lineitem)) WHERE r <= 4 ORDER BY l_extendedprice DESC, k LIMIT 120")
def rk1_pick_targets(spark, d):
    l = read_table(spark, d, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").cast("string")))
    return selection.pick_targets(l, "l_suppkey", "l_extendedprice", "k", cap=4, top=120).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")


@query(f"WITH {PRODUCTS}, w AS (SELECT product_key, list_filter(string_split(trim(regexp_replace(lower(product_name), '[^a-z0-9]+', '-', 'g'), '-'), '-'), lambda x: x <> '' AND x NOT IN {C.CONCEPT_STOPWORDS}) AS w FROM prod) SELECT product_key, coalesce(nullif(array_to_string(list_sort(w[1:4]), '-'), ''), product_key) AS concept FROM w")
def rk2_concept(spark, d):
    return products(spark, d).select("product_key", selection.concept(F.col("product_name"), F.col("product_key")).alias("concept"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey || '|' || l_returnflag || '|' || round_even(l_extendedprice::DECIMAL(18,6), 0)::BIGINT AS line FROM lineitem")
def rk4_line_key(spark, d):
    l = read_table(spark, d, "lineitem")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", selection.line_key(F.col("l_suppkey").cast("string"), F.col("l_returnflag"), F.col("l_extendedprice")).alias("line"))


CANDIDATES = f"{JOB}, cand AS (SELECT product_key, supplier_key, collection, product_name AS name, product_score, retail_price, least(1.0, 0.4 + 0.15 * len(image_urls)) AS content FROM classed WHERE status IN ('Shortlisted', 'Manually Approved', 'Enriched') AND selection_status = 'Not Selected' AND retail_price BETWEEN 900 AND 990)"


@query(f"WITH {CANDIDATES} SELECT product_key, coalesce(supplier_key, 'unknown') AS supplier_key, collection, name, product_score::DOUBLE AS product_score, retail_price::DOUBLE AS price, round(content, 6)::DOUBLE AS content_potential FROM cand")
def fl4_fl5_candidates(spark, d):
    return selection.build_candidates(job(spark, d), low=900, high=990).withColumn("content_potential", F.round("content_potential", 6))


def pool(spark, d):
    """A wide pool: every product, with a score from its key's hash."""
    p = classify.classify(products(spark, d), CFG)
    score = F.round(40 + F.conv(F.substring(F.md5("product_key"), 1, 6), 16, 10).cast("long") % 600 / 10.0, 1)
    return p.select("product_key", F.coalesce("supplier_key", F.lit("unknown")).alias("supplier_key"), "collection", F.col("product_name").alias("name"), score.alias("product_score"), F.col("suggested_retail_price").cast("double").alias("price"), F.least(F.lit(1.0), 0.4 + 0.15 * F.size("image_urls")).alias("content_potential"))


WORDS_SQL = f"list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), '-'), lambda x: x <> '' AND x NOT IN {C.CONCEPT_STOPWORDS})"
POOL_SQL = f"""{PRODUCTS}, {classified_sql('prod', 'product_name || chr(32) || coalesce(subcategory, chr(0)) || chr(32) || coalesce(description, chr(0))', 'category || chr(32) || coalesce(subcategory, chr(0))', 'product_key, supplier_key, product_name, suggested_retail_price, image_urls')},
pool0 AS (SELECT product_key, coalesce(supplier_key, 'unknown') AS supplier_key, collection, product_name AS name, round(40 + ('0x' || substr(md5(product_key), 1, 6))::BIGINT % 600 / 10.0::DOUBLE, 1) AS product_score, suggested_retail_price::DOUBLE AS price, least(1.0::DOUBLE, 0.4::DOUBLE + 0.15::DOUBLE * len(image_urls)) AS content FROM classed),
pool AS (SELECT *, coalesce(nullif(array_to_string(list_sort(({WORDS_SQL})[1:4]), '-'), ''), product_key) AS concept, CASE WHEN price IS NOT NULL THEN supplier_key || '|' || collection || '|' || round_even(price::DECIMAL(18,6), 0)::BIGINT END AS line FROM pool0)""".replace("chr(0)", "''")


def greedy_sql(name: str, source: str, picks: int, least: int, most: int, per_supplier: int, start: str = "", only: str = "", value: str = "") -> str:
    """A recursive table of picks: each step takes the best row that is allowed, scored against the picks so far. start: a table of the state to go on from; only, value: a further condition, another score."""
    names = ("product_key", "supplier_key", "collection", "concept", "line", "price", "product_score")
    many = lambda c: f"len(list_filter(r.{c}s, lambda x: x = p.{c}))"
    score = f"""p.product_score + CASE WHEN {many('collection')} < {least} THEN 6 * ({least} - {many('collection')}) / {least}::DOUBLE ELSE 0.0::DOUBLE END - 4 * {many('supplier_key')}
      + CASE WHEN p.price IS NOT NULL AND len(r.known) > 0 THEN least(3.0::DOUBLE, 3.0::DOUBLE * abs(p.price - list_avg(r.known)) / greatest(1.0::DOUBLE, list_avg(r.known))) ELSE 0.0::DOUBLE END + 4 * p.content - 8 * {many('concept')}"""
    begin = start or "SELECT 0 AS n, " + ", ".join(f"[]::{'DOUBLE' if c in ('price', 'product_score') else 'VARCHAR'}[] AS {c}s" for c in names) + ", []::DOUBLE[] AS known"
    return f"""{name} AS ({begin} UNION ALL
  SELECT n + 1, {', '.join(f'list_append({c}s, {c})' for c in names)}, CASE WHEN price IS NULL THEN known ELSE list_append(known, price) END FROM (
    SELECT r.*, p.*, row_number() OVER (ORDER BY round({value or score}, 9) DESC, p.product_score DESC, p.product_key) AS place FROM {name} r, {source} p
    WHERE n < {picks} AND {many('collection')} < {most} AND {many('supplier_key')} < {per_supplier} AND {many('concept')} < 2 AND (p.line IS NULL OR NOT list_contains(r.lines, p.line)) AND NOT list_contains(r.product_keys, p.product_key) {only}) WHERE place = 1)"""


def picked_sql(name: str, skip: int = 0) -> str:
    """The rows of the last state, in order."""
    get = lambda c: f"{c}s[i] AS {c}"
    return f"SELECT (i - {skip})::INT AS pick, {', '.join(map(get, ('product_key', 'supplier_key', 'collection', 'concept', 'product_score', 'price')))} FROM (SELECT *, unnest(range({skip} + 1, len(product_keys) + 1)) AS i FROM (SELECT * FROM {name} ORDER BY n DESC LIMIT 1))"


SEL = C.Selection()
BEST = greedy_sql("best", "pool", SEL.total_max, SEL.per_collection_min, SEL.per_collection_max, SEL.per_supplier_max)


@query(f"""WITH {POOL_SQL}, same AS (SELECT *, row_number() OVER (PARTITION BY collection, supplier_key, concept, price, content ORDER BY product_score DESC, product_key) AS r FROM pool),
one AS (SELECT *, product_score + 4 * content AS b FROM same WHERE r = 1 OR (price IS NULL AND r <= 2)),
floors AS ({' UNION ALL '.join(f"SELECT '{v}' AS kind, collection, v AS floor FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY v DESC) AS k FROM (SELECT collection, concept, max(v) AS v FROM (SELECT collection, supplier_key, max({v}) AS v, (max({{'v': {v}, 'c': concept}})).c AS concept FROM one GROUP BY 1, 2) GROUP BY 1, 2)) WHERE k = 81" for v in ('b', 'product_score'))})
SELECT product_key, collection, product_score FROM one LEFT JOIN (SELECT collection, max(floor) FILTER (kind = 'b') AS f1, max(floor) FILTER (kind = 'product_score') AS f2 FROM floors GROUP BY 1) USING (collection) WHERE f1 IS NULL OR f2 IS NULL OR b + 3 >= f1 OR product_score >= f2""")
def rk5_prune(spark, d):
    return selection.prune(selection.marked(pool(spark, d)), 40).select("product_key", "collection", "product_score")


@query(f"WITH RECURSIVE {POOL_SQL}, {BEST} {picked_sql('best')}")
def rk6_rk8_assortment(spark, d):
    return selection.select_assortment(pool(spark, d), SEL)[0]


GONE = "kept AS (SELECT " + ", ".join(f"list({c} ORDER BY i) FILTER (i > 3) AS {c}s" for c in ("product_key", "supplier_key", "collection", "concept", "line", "price", "product_score")) + ", list(price ORDER BY i) FILTER (i > 3 AND price IS NOT NULL) AS known, count(*) - 3 AS n FROM (SELECT unnest(range(1, len(product_keys) + 1)) AS i, " + ", ".join(f"unnest({c}s) AS {c}" for c in ("product_key", "supplier_key", "collection", "concept", "line", "price", "product_score")) + " FROM (SELECT * FROM best ORDER BY n DESC LIMIT 1)))"
STATE = ", ".join(f"{c}s" for c in ("product_key", "supplier_key", "collection", "concept", "line", "price", "product_score"))
WANTED = f"""{greedy_sql('wanted', 'pool', 3, 1, 4, 2, only=f"AND p.collection = {[C.KITCHEN, C.COMFORT, C.CATCH_ALL]}[n + 1]", value='p.product_score')}, {greedy_sql('arrivals', 'pool', 4, 1, 4, 2, f"SELECT n, {STATE}, known FROM (SELECT * FROM wanted ORDER BY n DESC LIMIT 1)")}"""


@query(f"WITH RECURSIVE {POOL_SQL}, {WANTED} {picked_sql('arrivals')}")
def rk9_new_arrivals(spark, d):
    return selection.select_new_arrivals(pool(spark, d), SEL)


REFILL = greedy_sql("refill", "rest", SEL.total_max, SEL.per_collection_min, SEL.per_collection_max, SEL.per_supplier_max, f"SELECT n, {STATE}, known FROM kept")


@query(f"WITH RECURSIVE {POOL_SQL}, {BEST}, {GONE}, rest AS (SELECT * FROM pool WHERE NOT list_contains((SELECT product_keys FROM best ORDER BY n DESC LIMIT 1), product_key)), {REFILL} {picked_sql('refill', 37)}")
def rk10_backfill(spark, d):
    p = pool(spark, d)
    first = selection.select_assortment(p, SEL)[0]
    kept = p.join(F.broadcast(first.select(F.col("product_key").alias("_k"))), F.col("product_key") == F.col("_k"), "left_semi")  # forty picks
    bad = [r["product_key"] for r in first.orderBy("pick").limit(3).collect()]
    return selection.reject_and_backfill(kept, p, bad, SEL)


@query(f"WITH RECURSIVE {POOL_SQL}, {BEST}, s AS ({picked_sql('best')}) SELECT 'b1' AS batch, count(*) AS total, count(*) FILTER (collection = 'Kitchen Convenience') AS kitchen_convenience, count(*) FILTER (collection = 'Dining') AS dining, count(*) FILTER (collection = 'Home Comfort') AS home_comfort, count(*) FILTER (collection = 'Bathroom') AS bathroom, count(*) FILTER (collection = 'Practical Finds') AS practical_finds, array_to_string(list_sort(list(product_key)), ', ') AS members FROM s")
def rk11_batch(spark, d):
    """The batch row of an assortment."""
    chosen, notes = selection.select_assortment(pool(spark, d), SEL)
    return selection.make_batch(chosen, "b1", notes).drop("notes")
