"""Landed pages: reading, pagination columns, caps, resume, path mapping, tagging, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_pages(spark: SparkSession, path: str, product: T.StructType) -> DataFrame:
    """One row per product of page files in any of three shapes: ``{"pages": [..]}``, ``{"products": [..]}``, a bare list.

    Columns: ``file, page_no, pos, cursor`` and the product's fields.
    """
    page = T.StructType([T.StructField("products", T.ArrayType(product)), T.StructField("cursor", T.StringType())])
    one = T.StructType([T.StructField("pages", T.ArrayType(page)), T.StructField("products", T.ArrayType(product)), T.StructField("cursor", T.StringType())])
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    bare = F.btrim("value", F.lit(" \t\r\n")).startswith("[")
    parsed = raw.select("file", F.when(bare, F.from_json("value", T.ArrayType(product))).alias("rows"), F.when(~bare, F.from_json("value", one)).alias("doc"))
    single = F.array(F.struct(F.coalesce("rows", "doc.products").alias("products"), F.col("doc.cursor").alias("cursor")))
    paged = parsed.select("file", F.posexplode(F.coalesce("doc.pages", single)).alias("page_no", "page"))
    return paged.select("file", (F.col("page_no") + 1).alias("page_no"), F.col("page.cursor").alias("cursor"), F.posexplode("page.products").alias("pos", "p")).select("file", "page_no", "pos", "cursor", "p.*")


def json_path(path: str) -> str:
    """``VARIANTS.0.PRICE`` -> ``$.VARIANTS[0].PRICE``."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))


def explode_response(df: DataFrame, raw: str, products_path: str, total_path: str | None = None) -> DataFrame:
    """One row per product of a raw JSON response; the response's columns stay, with ``pos``, ``product`` (JSON) and ``total``."""
    items = F.from_json(F.get_json_object(raw, json_path(products_path)), "array<string>", {"primitivesAsString": "true"})
    total = F.get_json_object(raw, json_path(total_path)).try_cast("long") if total_path else F.lit(None).cast("long")
    return df.select(*[c for c in df.columns if c != raw], total.alias("total"), F.posexplode_outer(items).alias("pos", "product"))


def map_paths(df: DataFrame, raw: str, paths: dict[str, str], defaults: dict[str, str] | None = None) -> DataFrame:
    """A column per dotted path of a JSON column; a miss gives the default."""
    def get(name: str, path: str) -> Column:
        found = F.get_json_object(raw, json_path(path))
        return F.coalesce(found, F.lit(defaults[name])) if defaults and name in defaults else found

    return df.select("*", *[get(n, p).alias(n) for n, p in paths.items()])


def url_template(template: str, key: Column) -> Column:
    """``https://x/{id}`` filled with a key."""
    return F.replace(F.lit(template), F.lit("{id}"), key.cast("string"))


def pull_item_field(arr: Column, field: str) -> Column:
    """A field of each JSON object in an array<string>; plain strings stay."""
    return F.transform(arr, lambda x: F.coalesce(F.get_json_object(x, "$." + field), F.when(~x.startswith("{"), x)))


def limit_per_group(df: DataFrame, group: str, order: list, n: int, page: str | None = None) -> DataFrame:
    """At most n rows per group; with ``page`` whole pages, until n rows are reached."""
    w = Window.partitionBy(group)
    if page is None:
        return df.withColumn("_r", F.row_number().over(w.orderBy(*order))).where(F.col("_r") <= n).drop("_r")
    sizes = df.groupBy(group, page).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(w.orderBy(page).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(sizes.withColumn("_b", before).where(F.col("_b") < n).select(group, page), [group, page], "left_semi")


def cap_offset(df: DataFrame, page: str, size: int, max_offset: int) -> DataFrame:
    """Pages (from 1) whose first row lies below the source's maximum offset."""
    return df.where((F.col(page) - 1) * size < max_offset)


def limited(df: DataFrame, order: list, n: int) -> tuple[DataFrame, bool]:
    """The first n rows, and whether there were more."""
    return df.orderBy(*order).limit(n), df.limit(n + 1).count() > n


def after_checkpoint(df: DataFrame, page: str, cursor: str, at: str | None) -> DataFrame:
    """Rows of pages after the one with cursor ``at``; all for none, no rows for an unknown cursor."""
    if at is None:
        return df
    done = df.where(F.col(cursor) == at).agg(F.max(page).alias("_done"))
    return df.join(F.broadcast(done), F.col(page) > F.col("_done")).drop("_done")


def page_log_check(pages: DataFrame, page: str, cursor: str, max_pages: int) -> DataFrame:
    """A row per violation: ``repeated cursor`` (each page after the first with it), ``page limit``. Pages are numbers, each logged once.

    Only the first page of each cursor is aggregated and joined, so a cursor of very many pages is no single task.
    """
    first = pages.where(F.col(cursor).isNotNull()).groupBy(F.col(cursor).alias("_c")).agg(F.min(page).alias("_first"))
    again = pages.join(first, F.col(cursor) == F.col("_c")).where(F.col(page) > F.col("_first"))
    return again.select(page, cursor, F.lit("repeated cursor").alias("violation")).unionByName(pages.where(F.col(page) > max_pages).select(page, cursor, F.lit("page limit").alias("violation")))


def tag_source(df: DataFrame, label: str, prefix: str, key: str) -> DataFrame:
    """The source's label, and its prefix before the key."""
    return df.withColumn("source_label", F.lit(label)).withColumn(key, F.concat_ws(":", F.lit(prefix), F.col(key).cast("string")))


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def conform_decimals(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """Half-even rounding to the declared decimals, stored as DECIMAL(18, d)."""
    return df.select(*[F.bround(F.col(c).cast("decimal(18,6)"), decimals[c]).cast(f"decimal(18,{decimals[c]})").alias(c) if c in decimals else F.col(c) for c in df.columns])


def flatten_rows(df: DataFrame, numbers: tuple[str, ...] = ()) -> DataFrame:
    """``{id, value}`` structs become the value, lists of them the ids, numeric texts of the named columns numbers."""
    out = []
    for f in df.schema:
        c, kind = F.col(f.name), f.dataType
        if isinstance(kind, T.StructType) and "value" in kind.names:
            c = c["value"]
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and "id" in kind.elementType.names:
            c = F.transform(c, lambda x: x["id"])
        elif f.name in numbers:
            c = c.try_cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def patch(df: DataFrame, updates: DataFrame, key: str, nulls: str = "keep") -> DataFrame:
    """Overwrite columns by key. ``keep``: a null update leaves the value; ``overwrite``: it replaces it. Keys in updates are unique."""
    cols = [c for c in updates.columns if c != key]
    u = updates.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in cols])
    new = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) if nulls == "keep" else F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in cols}
    return df.join(u, F.col(key) == F.col("_k"), "left").select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])


def market_shipping(zones: Column, codes: list[str]) -> Column:
    """Worst case over the target markets: of each code's first zone that covers it the largest cost, the least minimum and largest maximum of days, and how many are covered.

    zones: array<struct<cost double, min_days int, max_days int, locations array<string>>>; no zones: null.
    """
    hits = F.filter(F.transform(F.array(*[F.lit(c) for c in codes]), lambda c: F.try_element_at(F.filter(zones, lambda z: F.array_contains(z["locations"], c)), F.lit(1))), lambda z: z.isNotNull())
    worst = F.struct(F.array_max(F.transform(hits, lambda z: z["cost"])).alias("cost"), F.array_min(F.transform(hits, lambda z: z["min_days"])).alias("min_days"), F.array_max(F.transform(hits, lambda z: z["max_days"])).alias("max_days"), F.size(hits).alias("covered"))
    return F.when(F.coalesce(F.size(zones) > 0, F.lit(False)), worst)
