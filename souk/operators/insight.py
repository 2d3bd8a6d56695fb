"""Review screens and aggregates over the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions import schemas
from souk.session import written

DEAD = ("Scored Rejected", "Gate Failed", "Excluded By Supplier", "Manually Rejected")
SORTS = {"score": [("product_score", True)], "margin": [("margin_pct", True)], "price": [("retail_price", False)], "price_desc": [("retail_price", True)], "vs_market": [("price_vs_market", False)], "name": [("product_name", False)], "supplier": [("supplier_key", False)]}


def is_viable(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).isin(*DEAD)


def number(c: Column) -> Column:
    """Value of a plain decimal text, else null."""
    return F.when(c.rlike(r"^-?[0-9.]+$"), c).try_cast("double")


def semi_supplier(products: DataFrame, suppliers: DataFrame, text: str) -> DataFrame:
    s = suppliers.where(F.col("supplier_name").ilike(f"%{text}%")).select(F.col("supplier_key").alias("_s"))
    return products.join(s, F.col("supplier_key") == F.col("_s"), "left_semi")


def gallery(products: DataFrame, suppliers: DataFrame | None = None, equal: dict | None = None, enriched: bool | None = None, ships_from: list[str] | None = None, supplier: str | None = None, at_most: dict | None = None, at_least: dict | None = None, viable: bool = False, name: str | None = None, sort: str = "score", group: str | None = None, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """The filtered page (group first, nulls last, key breaks ties), and one row: total and whether the page is cut."""
    df = products
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v)
    if enriched is not None:
        df = df.where(F.col("enriched_at").isNotNull() if enriched else F.col("enriched_at").isNull())
    if ships_from:
        df = df.where(F.col("ships_from").isin(*ships_from))
    for c, v in (at_most or {}).items():
        df = df.where(F.col(c) <= v)
    for c, v in (at_least or {}).items():
        df = df.where(F.col(c) >= v)
    if viable:
        df = df.where(is_viable(F.col("review_status")))
    if name:
        df = df.where(F.col("product_name").ilike(f"%{name}%"))
    if supplier:
        df = semi_supplier(df, suppliers, supplier)
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in ([(group, False)] if group else []) + SORTS[sort]]
    return df.orderBy(*order, "product_key").limit(limit), df.agg(F.count("*").alias("total")).withColumn("truncated", F.col("total") > limit)


def view_filter(column: str, kind: str, value: object = None) -> Column:
    """equals | is_true | is_false | empty | not_empty; lists are empty without an element."""
    c = F.col(column)
    blank = F.coalesce(c.cast("string"), F.lit("")).isin("", "[]")
    return {"equals": c == value, "is_true": c, "is_false": ~c, "empty": blank, "not_empty": ~blank}[kind]


def register_views(df: DataFrame, views: dict[str, tuple]) -> None:
    """A temp view per name; a filter is (column, kind, value)."""
    for name, (column, kind, value) in views.items():
        df.where(view_filter(column, kind, value)).createOrReplaceTempView(name)


def validate_table(df: DataFrame, table: str) -> DataFrame:
    """A row per violation: required column that is missing, value outside a select's options (with its count)."""
    spec, spark = schemas.TABLES[table], df.sparkSession
    gone = [(f.name, None, "missing column", 1) for f in spec if not f.nullable and f.name not in df.columns]
    out = spark.createDataFrame(gone, "column_name string, value string, violation string, n long")
    for f in spec:
        options = f.metadata.get("options")
        if options and f.name in df.columns:
            bad = df.where(F.col(f.name).isNotNull() & ~F.col(f.name).isin(*options)).groupBy(F.col(f.name).alias("value")).agg(F.count("*").alias("n"))
            out = out.unionByName(bad.select(F.lit(f.name).alias("column_name"), "value", F.lit("unknown option").alias("violation"), "n"))
    return out


def product_detail(products: DataFrame, suppliers: DataFrame, key: Column, variants: str) -> DataFrame:
    """One product, its supplier, a row per variant."""
    s = suppliers.select(F.col("supplier_key").alias("_s"), *[c for c in suppliers.columns if c not in products.columns])
    return products.where(key).join(s, F.col("supplier_key") == F.col("_s"), "left").drop("_s").withColumn("variant", F.explode_outer(variants))


def variant_columns(df: DataFrame, key: str, json: str) -> DataFrame:
    """Per key all attribute names of its variants' JSON objects, sorted."""
    return df.select(key, F.explode(F.json_object_keys(json)).alias("k")).groupBy(key).agg(F.array_sort(F.collect_set("k")).alias("attributes"))


def label_category(df: DataFrame, labels: DataFrame, code: str, col: str) -> DataFrame:
    """Label of a category code where none is there. Labels are a short fixed list."""
    got = labels.select(F.col("code").alias("_c"), F.col("label").alias("_l"))
    return df.join(got, F.col(code) == F.col("_c"), "left").select(*[F.coalesce(F.col(c), F.col("_l")).alias(c) if c == col else F.col(c) for c in df.columns])


def stats(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """All totals in one pass over both tables."""
    one, none = F.lit(1), F.lit(0)
    has = lambda c: F.when(F.col(c).isNotNull(), 1).otherwise(0)
    rows = products.select(one.alias("products"), has("enriched_at").alias("enriched"), has("product_score").alias("scored"), (1 - has("enriched_at")).alias("unenriched"), none.alias("suppliers"))
    rows = rows.unionByName(suppliers.select(*[none.alias(c) for c in ("products", "enriched", "scored", "unenriched")], one.alias("suppliers")))
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns])


def stats_by(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(col), F.lit("Unclassified")).alias("label")).agg(F.count("*").alias("total"), F.count("enriched_at").alias("enriched"), F.count("product_score").alias("scored"))


def quick_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """All counts in one pass."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def bucket_counts(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """Rows below the first edge, in [edge, next), and from the last edge on; nulls in none."""
    c, n = F.col(col), len(edges)
    b = F.lit(n)
    for i in reversed(range(n)):
        b = F.when(c < edges[i], i).otherwise(b)
    # nulls have a bucket of their own that the join drops: a filter on them would be pushed into what made the column, and repeat it
    got = df.groupBy(F.when(c.isNull(), -1).otherwise(b).alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("_b"))
    return every.join(got, F.col("_b") == F.col("bucket"), "left").select(F.col("_b").alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))


def winners_by(df: DataFrame, col: str, winner: Column) -> DataFrame:
    """Winners and all rows per value, and in all (value null, is_total), in one pass."""
    return df.rollup(col).agg(F.count_if(winner).alias("winners"), F.count("*").alias("total"), F.grouping(col).cast("int").alias("is_total"))


def facets(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts per value of each column, all in one pass."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in cols])).alias("f")).select("f.*")
    return each.where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def stock_total(df: DataFrame, key: str, quantity: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(F.coalesce(F.col(quantity), F.lit(0)).cast("decimal(18,2)")).alias("stock"))


def placed(df: DataFrame, *order) -> DataFrame:
    """df with ``place``, from 1 in an order that leaves no ties. Each range of the order is numbered by itself; only the ranges' counts meet."""
    laid = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = laid.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return laid.join(before, "_range").withColumn("place", place.cast("int")).drop("_range", "_before")


def endpoint_summary(log: DataFrame, method: str, endpoint: str, seq: str, likely: Column) -> DataFrame:
    """Per method and endpoint its first response's place in the log and whether that looked like an API; ``place``: likely ones first, then as seen."""
    first = F.min(F.struct(F.col(seq).alias("seq"), likely.alias("likely"))).alias("f")
    out = log.groupBy(method, endpoint).agg(first, F.count("*").alias("responses"))
    return placed(out.select(method, endpoint, F.col("f.seq").alias("first_seen"), "responses", F.col("f.likely").alias("likely_api")), F.desc("likely_api"), "first_seen")


def share(df: DataFrame, n: str) -> DataFrame:
    """Per cent of the whole, one decimal."""
    whole = df.agg(F.sum(n).alias("_w"))
    return df.crossJoin(whole).withColumn("pct", F.bround((F.col(n) * 100 / F.col("_w")).cast("decimal(18,6)"), 1).cast("decimal(5,1)")).drop("_w")
