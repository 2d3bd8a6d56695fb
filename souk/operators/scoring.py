"""Gates, criteria, weighted scores and statuses of suppliers and products, as one select each."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions import config as C
from souk.operators import classify, pricing


def reasons(*rules: tuple[Column, str]) -> Column:
    """Codes of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in rules]))


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _lower(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)


def _names(values) -> Column:
    return F.split(F.lit("|".join(v.lower() for v in values)), "[|]")


def weighted_score(criteria: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of criterion times weight, one decimal, half-even; weights add up to 100."""
    if abs(sum(weights.values()) - 100) > 1e-9:
        raise ValueError("weights must add up to 100")
    total = F.lit(0).cast("decimal(24,8)")
    for name, w in weights.items():
        total = total + F.coalesce(criteria[name].cast("decimal(18,8)"), F.lit(0)) * F.lit(int(w) if float(w).is_integer() else w).cast("decimal(6,2)")
    return F.bround(total.cast("decimal(18,6)"), 1).cast("decimal(5,1)")


def supplier_gates(cfg: C.Config) -> Column:
    g = cfg.supplier_gates
    ships = _lower(F.col("ships_to_countries"))
    sends = F.concat(_lower(F.array_compact(F.array(F.col("location_country")))), _lower(F.col("dispatch_countries")))
    off = F.lit(False)
    return reasons(
        (~F.coalesce(F.col("active"), F.lit(False)), "INACTIVE"),
        ((F.size(ships) > 0) & ~F.arrays_overlap(ships, _names(cfg.markets)) if g.require_target_market else off, "NO_TARGET_MARKET"),
        (~F.arrays_overlap(sends, _names(cfg.dispatch_allowed)) if g.require_dispatch_in_allowed else off, "DISPATCH_OUTSIDE_EUROPE"),
        (F.col("shipping_max_days").isNull() if g.require_known_shipping else off, "SHIPPING_UNKNOWN"),
        (F.col("shipping_max_days") > g.max_shipping_days, "SHIPPING_TOO_SLOW"),
        (F.coalesce(F.col("relevant_product_count"), F.lit(0)) < 1, "INSUFFICIENT_RELEVANT_PRODUCTS"),
        (F.col("data_completeness_pct") < g.minimum_data_completeness_pct, "LOW_DATA_COMPLETENESS"),
        (~F.coalesce(F.col("shipping_policy_available"), F.lit(False)) if g.require_shipping_policy else off, "NO_SHIPPING_POLICY"),
        (~F.coalesce(F.col("return_policy_available"), F.lit(False)) if g.require_return_policy else off, "NO_RETURN_POLICY"),
    )


def _codes(values) -> Column:
    return F.split(F.lit("|".join(values)), "[|]")


def _tri(c: Column) -> Column:
    return F.when(c.isNull(), 0.5).when(c, 1.0).otherwise(0.0)


def supplier_criteria(cfg: C.Config) -> dict[str, Column]:
    """Nine values from 0 to 1; what is unknown counts half or nothing, as each rule says."""
    targets = _names(cfg.markets)
    sends = F.concat(_lower(F.array_compact(F.array(F.col("location_country")))), _lower(F.col("dispatch_countries")))
    return {
        "market_coverage": F.size(F.array_intersect(F.array_distinct(_lower(F.col("ships_to_countries"))), targets)) / len(cfg.markets),
        "shipping_speed": F.coalesce(unit(1 - F.col("shipping_max_days") / (2.0 * cfg.supplier_gates.max_shipping_days)), F.lit(0.0)),
        "dispatch_proximity": F.when(F.arrays_overlap(sends, targets), 1.0).otherwise(0.0),
        "data_completeness": unit(F.coalesce(F.col("data_completeness_pct"), F.lit(0)) / 100.0),
        "return_policy": _tri(F.col("return_policy_available")),
        "shipping_policy": _tri(F.col("shipping_policy_available")),
        "rating": F.coalesce(unit(F.col("supplier_rating") / 5.0) * (0.5 + 0.5 * unit(F.coalesce(F.col("review_count"), F.lit(0)) / 20.0)), F.lit(0.5)),
        "catalog_depth": unit(F.coalesce(F.col("relevant_product_count"), F.lit(0)) / 5.0),
        "low_friction": F.when(F.coalesce(F.col("approval_required"), F.lit(False)), 0.0).otherwise(1.0),
    }


def score_suppliers(suppliers: DataFrame, cfg: C.Config) -> DataFrame:
    """Adds supplier_score, gate_passed, eligibility and reasons. A manual override wins over gates and score."""
    s = cfg.supplier_scoring
    over = F.coalesce(F.col("manual_override"), F.lit("None")) if "manual_override" in suppliers.columns else F.lit("None")
    out = suppliers.withColumns({"_gate": supplier_gates(cfg), "supplier_score": weighted_score(supplier_criteria(cfg), s.weights)})
    passed, low = F.size("_gate") == 0, F.col("supplier_score") < s.reject_below
    good = F.col("supplier_score") >= s.accept_from if s.accept_from is not None else F.lit(False)
    eligibility = F.when(over == "Block", "Manually Blocked").when(over == "Approve", "Manually Approved").when(~F.coalesce(F.col("active"), F.lit(False)), "Inactive").when(~passed, "Gate Failed").when(low, "Scored Rejected").when(good, "Approved").otherwise("Manual Review")
    scored = ~over.isin("Block", "Approve") & passed
    more = reasons((over == "Block", "MANUALLY_BLOCKED"), (over == "Approve", "MANUALLY_APPROVED"), (scored & low, "LOW_SUPPLIER_SCORE"), (scored & F.coalesce(F.col("approval_required"), F.lit(False)), "APPROVAL_REQUIRED"))
    return out.withColumns({"gate_passed": passed, "eligibility": eligibility, "reasons": F.concat("_gate", more)}).drop("_gate")


def blocks_products(c: Column) -> Column:
    return c.isin(*C.BLOCKING)


def tally(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def with_supplier(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Products with their supplier's eligibility and score; without one: Unscored and 0."""
    s = suppliers.select(F.col("supplier_key").alias("_s"), F.col("eligibility").alias("_e"), F.col("supplier_score").alias("_v"))
    return products.join(s, F.col("supplier_key") == F.col("_s"), "left").withColumns({"supplier_eligibility": F.coalesce("_e", F.lit("Unscored")), "supplier_score": F.coalesce("_v", F.lit(0).cast("decimal(5,1)"))}).drop("_s", "_e", "_v")


def says(*cols: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))


def is_excluded(c: Column, patterns=C.EXCLUDED) -> Column:
    """All patterns in one pass."""
    return F.coalesce(c.rlike("(?iuU)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def stems(pattern: str) -> list[str]:
    """For each alternative of ``\\b(..|..)\\b`` its longest literal run, which any match holds."""
    inner = re.fullmatch(r"\\b\((.*)\)\\b", pattern).group(1)
    return sorted({max(re.split(r"\[[^\]]*\]\??|\\s\??|.\?", part), key=len) for part in inner.split("|")})


def risk_flags(low: str) -> Column:
    """Flags of a column of lower-case texts. A pattern is only tried where one of its stems stands."""
    some = {p: F.expr(" OR ".join(f'contains({low}, "{w}")' for w in stems(p))) for _, p in C.RISKS}
    return F.array_compact(F.array(*[F.when(some[p] & F.col(low).rlike("(?U)" + p), F.lit(flag)) for flag, p in C.RISKS]))


def risk_reasons(flags: Column) -> Column:
    return reasons((F.arrays_overlap(flags, _codes(C.COMPLIANCE)), "HIGH_COMPLIANCE_RISK"), (F.arrays_overlap(flags, _codes(C.REFUND)), "HIGH_REFUND_RISK"))


def in_stock(status: str = "stock_status", quantity: str = "stock_quantity") -> Column:
    s = F.lower(F.coalesce(F.col(status), F.lit("")))
    return F.when(s.isin("out of stock", "outofstock"), False).when(F.col(quantity).isNotNull(), F.col(quantity) > 0).otherwise(True)


def product_gates(cfg: C.Config, eligible: Column) -> Column:
    g = cfg.product_gates
    off = F.lit(False)
    image = F.coalesce(F.col("main_image_url") != "", F.lit(False)) | F.coalesce(F.size("image_urls") > 0, F.lit(False))
    return reasons(
        (~eligible, "SUPPLIER_REJECTED"),
        (~F.coalesce(F.col("active"), F.lit(False)), "INACTIVE"),
        (F.coalesce(F.btrim("product_name"), F.lit("")) == "", "NO_TITLE"),
        (is_excluded(says("product_name", "description", "category", "subcategory")), "EXCLUDED_PRODUCT_TYPE"),
        (~image if g.require_image else off, "INSUFFICIENT_IMAGES"),
        (F.col("supplier_price").isNull() if g.require_known_supplier_price else off, "MISSING_PRICE"),
        (~in_stock() if g.require_in_stock else off, "OUT_OF_STOCK"),
        (F.col("shipping_max_days") > g.max_shipping_days, "SHIPPING_TOO_SLOW"),
    )


def product_criteria(cfg: C.Config, coverage: Column | None = None) -> dict[str, Column]:
    """Eight values from 0 to 1; needs margin columns, ``risk_flags`` and ``supplier_score``. coverage: share of target markets served (all, if not known)."""
    m = cfg.margin
    share = unit(F.coalesce(F.col("competitiveness"), F.lit(0)).cast("double")) if m.mode == "target_margin" else unit(F.coalesce(F.col("margin_pct"), F.lit(0)).cast("double") / float(m.target_margin_pct))
    days = F.coalesce(unit(1 - F.col("shipping_max_days") / (2.0 * cfg.product_gates.max_shipping_days)), F.lit(0.3))
    images = F.coalesce(F.size("image_urls"), F.lit(0))
    held = lambda c: F.when(F.coalesce(F.btrim(F.col(c).cast("string")), F.lit("")) != "", 1).otherwise(0)
    facts = held("product_name") + held("description") + F.when(F.coalesce(F.col("supplier_price"), F.lit(0)) != 0, 1).otherwise(0) + F.when(images > 0, 1).otherwise(0) + held("brand")
    return {
        "problem_solved": unit(0.5 + 0.15 * F.regexp_count(says("product_name", "description"), F.lit("(?U)" + C.PROBLEM_WORDS))),
        "margin_potential": share,
        "shipping": days * (F.lit(1.0) if coverage is None else F.coalesce(coverage, F.lit(1.0))),
        "content_potential": unit(0.3 + 0.15 * images + F.least(F.lit(0.4), F.length(F.coalesce("description", F.lit(""))) / 600.0)),
        "differentiation": F.when(held("brand") == 1, 0.6).otherwise(0.45),
        "return_risk": F.when(F.arrays_overlap("risk_flags", _codes(C.REFUND)), 0.4).otherwise(0.9),
        "data_quality": facts / 5.0,
        "supplier_strength": unit(F.col("supplier_score").cast("double") / 100.0),
    }


def score_products(products: DataFrame, suppliers: DataFrame, rates: DataFrame | None, cfg: C.Config) -> DataFrame:
    """The product job in one plan: supplier, gates, margin, criteria, score, review status, collection. Manual decisions stay."""
    s = cfg.product_scoring
    df = with_supplier(products, suppliers)
    if rates is not None:
        df = pricing.to_currency(df, ["supplier_price", "shipping_cost", "suggested_retail_price"], rates)
    df = df.withColumns({"_gate": product_gates(cfg, ~blocks_products(F.col("supplier_eligibility"))), "_said": says("product_name", "description")})
    df = df.withColumn("risk_flags", risk_flags("_said")).drop("_said")
    df = pricing.margin(df, cfg.margin)
    passed = F.size("_gate") == 0
    df = df.withColumn("product_score", F.when(passed, weighted_score(product_criteria(cfg, F.col("market_coverage") if "market_coverage" in df.columns else None), s.weights)).otherwise(F.lit(0).cast("decimal(5,1)")))
    flagged, part = F.size("risk_flags") > 0, F.col("margin_status")
    below = part == "Below Minimum"
    force, low = flagged | (part == "Incomplete"), F.col("product_score") < s.reject_below
    good = F.col("product_score") >= s.accept_from if s.accept_from is not None else F.lit(False)
    status = F.when(F.array_contains("_gate", "SUPPLIER_REJECTED"), "Excluded By Supplier").when(~passed, "Gate Failed").when(below, "Scored Rejected").when(force, "Manual Review").when(low, "Scored Rejected").when(good, "Shortlisted").otherwise("Manual Review")
    more = F.concat(
        risk_reasons(F.col("risk_flags")),
        reasons((part == "Incomplete", "MARGIN_UNKNOWN"), (below, "LOW_MARGIN"), (F.col("shipping_estimated") & (part != "Incomplete"), "MARGIN_ESTIMATED"), (F.col("uncompetitive"), "UNCOMPETITIVE_PRICE"), (~below & ~force & low, "LOW_PRODUCT_SCORE")),
    )
    kept = F.col("review_status").isin(*C.MANUAL_STATUSES) if "review_status" in products.columns else F.lit(False)
    old = F.col("review_status") if "review_status" in products.columns else F.lit(None).cast("string")
    df = df.withColumns({"review_status": F.when(kept, old).otherwise(status), "reasons": F.when(passed, F.concat("_gate", more)).otherwise(F.col("_gate"))})
    return classify.classify(df, cfg).drop("_gate")


def encode_reasons(c: Column) -> Column:
    return F.array_join(c, ", ")


def decode_reasons(c: Column) -> Column:
    return F.filter(F.split(c, ", "), lambda x: x != "")


def reason_counts(df: DataFrame, col: str = "reasons") -> DataFrame:
    return df.select(F.explode(col).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
