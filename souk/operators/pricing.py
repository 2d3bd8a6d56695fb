"""Currency conversion and margins. Money is DECIMAL(18,6), rounded half-even to cents where it is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions import config as C


def money(c: Column) -> Column:
    return c.cast("decimal(18,6)")


def cents(c: Column) -> Column:
    return F.bround(money(c), 2).cast("decimal(18,2)")


def rate_table(spark: SparkSession, rates: dict[str, float] | None = None) -> DataFrame:
    """currency -> value of one unit in the target currency; a fixed list, small by nature."""
    return spark.createDataFrame(sorted((rates or C.FALLBACK_RATES).items()), "currency string, rate double")


def invert(rates: DataFrame) -> DataFrame:
    """Units per target unit to value of a unit."""
    return rates.select("currency", F.try_divide(F.lit(1.0), F.col("rate")).alias("rate"))


def choose_rates(candidates: DataFrame, now: float, max_age: float, auto: bool = True) -> DataFrame:
    """The table to use among ``origin`` cache, live and fallback: fresh cache, else live, else stale cache, else fallback.

    candidates: origin, fetched_at, currency, rate. Without ``auto`` only fallback counts.
    An empty live answer (a row without currency) goes on to the fallback, not the stale cache.
    """
    fresh = (F.col("origin") == "cache") & (F.lit(now) - F.col("fetched_at") <= max_age)
    priority = F.when(F.col("origin") == "fallback", 3)
    if auto:
        priority = F.when(fresh, 0).when(F.col("origin") == "live", 1).when(F.col("origin") == "cache", 2).otherwise(priority)
    ranked = candidates.withColumn("_p", priority).where("_p is not null")
    best = ranked.agg(F.min("_p").alias("_b"), F.max(F.when((F.col("_p") == 1) & F.col("currency").isNotNull(), True)).alias("_live"))
    pick = F.when((F.col("_b") == 1) & F.col("_live").isNull(), 3).otherwise(F.col("_b"))
    return ranked.join(F.broadcast(best), F.col("_p") == pick).where("currency is not null").select("origin", "currency", "rate")


def to_currency(df: DataFrame, cols: list[str], rates: DataFrame, currency: str = "currency") -> DataFrame:
    """Columns times the rate of the row's currency; unknown currencies stay as they are."""
    r = rates.select(F.upper("currency").alias("_c"), F.col("rate").alias("_rate"))
    met = df.join(F.broadcast(r), F.upper(F.col(currency)) == F.col("_c"), "left")
    return met.select(*[F.coalesce(F.col(c) * F.col("_rate"), F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def margin(df: DataFrame, m: C.Margin, mode: Column | None = None, target: Column | None = None, markup: Column | None = None) -> DataFrame:
    """Adds landed_cost, margin_amount, margin_pct, retail_price, market_price, competitiveness, uncompetitive, shipping_estimated, margin_status, price_vs_market.

    Needs supplier_price, shipping_cost, shipping_cost_known, suggested_retail_price
    (and proposed_retail_price, if there is one). mode, target and markup may be
    columns, for what-if grids.
    """
    mode = mode if mode is not None else F.lit(m.mode)
    target = target if target is not None else F.lit(float(m.target_margin_pct))
    markup = markup if markup is not None else F.lit(float(m.markup_multiple))
    above = lambda c: F.when(F.col(c) > 0, F.col(c))
    retail = F.coalesce(above("proposed_retail_price"), above("suggested_retail_price")) if "proposed_retail_price" in df.columns else above("suggested_retail_price")
    known = F.coalesce(F.col("shipping_cost_known"), F.lit(False)) & F.col("shipping_cost").isNotNull()
    guess = cents(F.col("supplier_price") * m.assumed_shipping_pct / 100) if m.estimate_shipping else F.lit(None).cast("decimal(18,2)")
    out = df.withColumns({"_price": F.col("supplier_price").cast("double"), "_ship": F.when(known, F.col("shipping_cost")).otherwise(guess).cast("double"), "market_price": retail.cast("double"), "shipping_estimated": ~known & F.lit(m.estimate_shipping)})
    base, fee = F.col("_price") + F.col("_ship"), m.fee_rate
    room = F.lit(1 - fee) - target / 100
    rrp = F.col("market_price") * (1 - m.rrp_discount_pct / 100)
    loop = F.lit(1.0) - markup * fee
    asked = F.when(mode == "target_margin", F.when(room > 0, F.try_divide(base, room)).otherwise(F.col("market_price"))).when(mode == "markup", F.when(loop > 0, F.try_divide(base * markup, loop)).otherwise(base * markup)).otherwise(rrp)
    whole = F.col("_price").isNotNull() & F.col("_ship").isNotNull() & F.col("market_price").isNotNull()
    out = out.withColumn("_ask", F.when(whole, asked)).withColumn("_ask", F.when(F.col("_ask") > 0, F.col("_ask")))
    out = out.withColumn("landed_cost", cents(base + F.col("_ask") * fee))
    out = out.withColumn("margin_amount", cents(money(F.col("_ask")) - F.col("landed_cost")))
    out = out.withColumn("margin_pct", F.bround(money(F.try_divide(F.col("margin_amount").cast("double"), F.col("_ask")) * 100), 1).cast("decimal(10,1)"))
    out = out.withColumns(
        {
            "retail_price": cents(F.col("_ask")),
            "competitiveness": cents(F.try_divide(F.col("market_price"), F.col("_ask"))),
            "uncompetitive": F.coalesce(F.col("_ask") > m.uncompetitive_over_rrp * F.col("market_price"), F.lit(False)),
            "price_vs_market": F.bround(money(F.try_divide(F.col("_ask") - F.col("market_price"), F.col("market_price")) * 100), 1).cast("decimal(18,1)"),
            "margin_status": F.when(F.col("_ask").isNull(), "Incomplete").when(F.col("margin_pct") < m.minimum_margin_pct, "Below Minimum").when(F.col("margin_pct") >= target, "Target Met").otherwise("Acceptable"),
            "market_price": cents(F.col("market_price")),
        }
    )
    return out.drop("_price", "_ship", "_ask")


def what_if(df: DataFrame, grid: list[tuple[str, float, float, float]], m: C.Margin) -> DataFrame:
    """Counts per pricing mode, target, markup and minimum; the grid is a short parameter list, each row meets each entry."""
    entry = lambda e: F.struct(F.lit(e[0]).alias("g_mode"), F.lit(float(e[1])).alias("g_target"), F.lit(float(e[2])).alias("g_markup"), F.lit(float(e[3])).alias("g_minimum"))
    each = df.select("*", F.explode(F.array(*map(entry, grid))).alias("_g")).select(*df.columns, "_g.*")
    met = margin(each, m, F.col("g_mode"), F.col("g_target"), F.col("g_markup"))
    return met.groupBy(F.col("g_mode").alias("mode"), F.col("g_target").alias("target"), F.col("g_markup").alias("markup"), F.col("g_minimum").alias("minimum")).agg(F.count_if(F.col("margin_pct") >= F.col("g_minimum")).alias("sellable"), F.count_if("uncompetitive").alias("uncompetitive"), F.count("*").alias("products"))
