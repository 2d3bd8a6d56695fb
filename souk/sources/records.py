"""Whole records: raw suppliers and products of any source, as one program of column rules.

Raw fields are texts as they stand in the source's JSON (numbers and booleans with
them), lists of texts, and structs for variants and shipping zones. What a source
does not have is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.functions import config as C
from souk.functions import rules as R
from souk.sources.pages import market_shipping

_S, _L = T.StringType(), T.ArrayType(T.StringType())


def _struct(texts: str, lists: str = "", more: dict | None = None) -> T.StructType:
    fields = [T.StructField(n, _S) for n in texts.split()] + [T.StructField(n, _L) for n in lists.split()]
    return T.StructType(fields + [T.StructField(n, k) for n, k in (more or {}).items()])


RAW_SUPPLIER = _struct("id name url country approval_required rating review_count catalog_count shipping_min_days shipping_max_days shipping_policy_available return_policy_available contact_available active manual_override", "dispatch_countries ships_to_countries")
VARIANT = _struct("sku id option title")
ZONE = T.StructType([T.StructField("cost", T.DoubleType()), T.StructField("min_days", T.IntegerType()), T.StructField("max_days", T.IntegerType()), T.StructField("locations", _L)])
RAW_PRODUCT = _struct(
    "id name url sku brand category subcategory description currency price default_currency_price suggested_retail_price shipping_cost shipping_min_days shipping_max_days stock_status stock_quantity main_image ships_from added_at updated_at active",
    "images", {"variants": T.ArrayType(VARIANT), "shipping_zones": T.ArrayType(ZONE), "supplier": RAW_SUPPLIER},
)

#: What counts towards a supplier's completeness.
COUNTED = ("supplier_name", "supplier_url", "location_country", "dispatch_countries", "ships_to_countries", "shipping_min_days", "shipping_max_days", "shipping_policy_available", "return_policy_available", "contact_information_available")


def _known(c: Column) -> Column:
    return F.when(c != "", c)


def active_flag(c: Column) -> Column:
    """True where nothing is said, null for an unknown word."""
    return F.when(c.isNull(), True).otherwise(R.tri_bool(c))


def said_or_true(c: Column) -> Column:
    """A boolean as it is; any other text that is not empty: true."""
    return F.when(F.lower(c) == "false", False).when(c == "", False).when(c.isNotNull(), True)


def named(c: Column, codes: dict[str, str]) -> Column:
    """Countries of a list by name: those given by code in ``codes``, then the rule for names."""
    names = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]) if codes else None
    return R.countries(c if names is None else F.transform(c, lambda x: F.coalesce(names[F.upper(F.btrim(x))], x)))


def supplier_record(raw: Column, codes: dict[str, str] | None = None) -> dict[str, Column]:
    """Name -> column of a normalized supplier. raw: a struct of ``RAW_SUPPLIER``; codes: country code -> name (the target markets, if none)."""
    codes = C.MARKET_CODES if codes is None else codes
    f = raw.getField
    return {
        "supplier_key": R.supplier_key(_known(f("id")), f("url"), f("name"), R.country(f("country"))),
        "source_supplier_id": R.text(_known(f("id"))),
        "supplier_name": R.text(f("name")),
        "supplier_url": R.url(f("url")),
        "location_country": F.get(named(F.array(f("country")), codes), F.lit(0)),
        "dispatch_countries": named(f("dispatch_countries"), codes),
        "ships_to_countries": named(f("ships_to_countries"), codes),
        "approval_required": R.tri_bool(f("approval_required")),
        "supplier_rating": R.price(f("rating")),
        "review_count": R.as_int(f("review_count")),
        "catalog_product_count": R.as_int(f("catalog_count")),
        "shipping_min_days": R.as_int(f("shipping_min_days")),
        "shipping_max_days": R.as_int(f("shipping_max_days")),
        "shipping_policy_available": R.tri_bool(f("shipping_policy_available")),
        "return_policy_available": R.tri_bool(f("return_policy_available")),
        "contact_information_available": said_or_true(f("contact_available")),
        "active": active_flag(f("active")),
        "manual_override": _known(f("manual_override")),
    }


def normalize_suppliers(df: DataFrame, raw: str = "supplier", codes: dict[str, str] | None = None) -> DataFrame:
    """A row per row of df: the record of the struct column ``raw``, and ``data_completeness_pct``. A supplier that nothing identifies has a null key."""
    out = df.select(*[c.alias(n) for n, c in supplier_record(F.col(raw), codes).items()])
    held = [F.size(c) > 0 if c.endswith("_countries") else F.col(c).isNotNull() for c in COUNTED]
    return out.withColumn("data_completeness_pct", R.completeness(*held))


def normalize_products(df: DataFrame, target_codes: list[str] | None = None) -> DataFrame:
    """A row per row of df, whose columns are those of ``RAW_PRODUCT``; keys by the ladder, the supplier's key with it.

    Prices stay in the supplier's currency; a zero or missing one gives way to
    ``default_currency_price``. Shipping is the worst case over the target markets that a
    zone covers; without any, the single fields. Products or suppliers that nothing
    identifies have null keys.
    """
    c = F.col
    supplier = R.supplier_key(_known(c("supplier.id")), c("supplier.url"), c("supplier.name"), R.country(c("supplier.country")))
    tokens = F.transform("variants", lambda v: F.concat_ws(":", *[F.coalesce(v.getField(n), F.lit("")) for n in VARIANT.names]))
    images = F.filter(F.transform("images", R.url), lambda u: u.isNotNull())
    price, other = R.price(c("price")), R.price(c("default_currency_price"))
    tms = market_shipping(c("shipping_zones"), target_codes) if target_codes else F.lit(None).cast("struct<cost:double,min_days:int,max_days:int,covered:int>")
    df = df.withColumns({"_supplier": supplier, "_tokens": F.coalesce(tokens, F.array().cast("array<string>")), "_images": F.coalesce(images, F.array().cast("array<string>")), "_tms": tms})
    zoned = F.coalesce(c("_tms.covered") > 0, F.lit(False))
    return df.select(
        R.product_key(c("_supplier"), _known(c("id")), c("sku"), c("url"), c("name"), c("_tokens")).alias("product_key"),
        R.text(_known(c("id"))).alias("source_product_id"),
        R.text(c("name")).alias("product_name"),
        R.url(c("url")).alias("product_url"),
        c("_supplier").alias("supplier_key"),
        *[R.text(c(n)).alias(to) for n, to in (("sku", "supplier_sku"), ("brand", "brand"), ("category", "category"), ("subcategory", "subcategory"))],
        R.strip_html(c("description")).alias("description"),
        R.text(c("currency")).alias("currency"),
        F.coalesce(F.nullif(price, F.lit(0.0)), other).alias("supplier_price"),
        R.price(c("suggested_retail_price")).alias("suggested_retail_price"),
        F.when(zoned, c("_tms.cost")).otherwise(R.price(c("shipping_cost"))).alias("shipping_cost"),
        F.when(zoned, c("_tms.cost").isNotNull()).otherwise(c("shipping_cost").isNotNull()).alias("shipping_cost_known"),
        *[F.when(zoned, c(f"_tms.{n}")).otherwise(R.as_int(c(f"shipping_{n}"))).alias(f"shipping_{n}") for n in ("min_days", "max_days")],
        c("_tms.covered").alias("target_markets_shipped"),
        F.when(c("_tms").isNotNull(), len(target_codes or [])).alias("target_markets_total"),
        R.text(c("stock_status")).alias("stock_status"),
        R.as_int(c("stock_quantity")).alias("stock_quantity"),
        F.size("_tokens").alias("variants_count"),
        R.variant_signature(c("_tokens")).alias("variant_signature"),
        F.coalesce(R.url(c("main_image")), F.get("_images", F.lit(0))).alias("main_image_url"),
        c("_images").alias("image_urls"),
        R.text(c("ships_from")).alias("ships_from"),
        R.ts_utc(c("added_at")).alias("added_at"),
        R.ts_utc(c("updated_at")).alias("updated_at"),
        active_flag(c("active")).alias("active"),
    )
