"""Tables for publishing: fields, content requests and answers, listing matches, push plan. No network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions import config as C
from souk.functions import rules


def publish_fields(df: DataFrame, vendor: str, shop_tag: str) -> DataFrame:
    """vendor (the shop's), product_type (of the collection, else Home), image (the main one or null), material, dimensions, weight, tags (collection, material, the shop's; no category), handle."""
    kinds = F.create_map(*[F.lit(x) for kv in C.TYPE_BY_COLLECTION.items() for x in kv])
    said = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("product_name", "description", "category", "subcategory")])
    out = df.withColumns({"vendor": F.lit(vendor), "product_type": F.coalesce(kinds[F.col("collection")], F.lit("Home")), "image": F.nullif("main_image_url", F.lit("")), "material": rules.material(said), "dimensions": rules.dimensions(said), "weight": rules.weight(said), "handle": rules.handle(F.col("product_name"), F.col("product_key"))})
    return out.withColumn("tags", base_tags(F.col("collection"), F.col("material"), F.lit(shop_tag)))


def base_tags(*tags: Column) -> Column:
    """Tags without the blanks around them, each once; null and empty ones left out."""
    said = F.transform(F.array(*tags), lambda t: F.regexp_replace(t, f"(?U)^{rules.BLANKS}|{rules.BLANKS}$", ""))
    return F.array_distinct(F.filter(said, lambda t: F.coalesce(t != "", F.lit(False))))


def content_requests(df: DataFrame, limit: int = 1500) -> DataFrame:
    """Key and the facts as JSON, nulls kept, the description clipped."""
    facts = F.struct(F.col("product_name").alias("name"), F.substring("description", 1, limit).alias("description"), F.col("category"), F.col("brand"))
    return df.select("product_key", F.to_json(facts, {"ignoreNullFields": "false"}).alias("facts"))


def parse_responses(df: DataFrame, col: str) -> DataFrame:
    """Adds ``content`` (JSON text of an object, code fences and text around it dropped) and ``error``."""
    t = F.btrim(F.regexp_replace(F.btrim(F.col(col)), r"^```(?:json)?\s*|\s*```$", ""))
    ok = lambda c: F.try_parse_json(c).isNotNull() & c.startswith("{")
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    content = F.when(ok(t), t).when((inner != "") & ok(inner), inner)
    return df.withColumn("content", content).withColumn("error", F.when(F.col("content").isNull(), "no JSON object"))


def content_fields(df: DataFrame, version: str, shop: str = "") -> DataFrame:
    """Final copy from ``content`` JSON: titles, texts, alt text, handle, tags."""
    get = lambda k: F.get_json_object("content", "$." + k)
    title = rules.clip(F.coalesce(get("title"), F.col("product_name")), 255)
    own = F.from_json(get("tags"), "array<string>")
    return df.withColumns({"title": title, "seo_title": rules.clip(F.coalesce(get("seo_title"), title), 60), "meta_description": rules.clip(get("meta_description"), 155), "description_html": get("description_html"), "image_alt_text": rules.clip(F.coalesce(get("image_alt_text"), title), 125), "handle": rules.handle(title, F.col("product_key")), "tags": rules.merge_tags(F.col("tags"), own) if "tags" in df.columns else rules.merge_tags(own, F.array().cast("array<string>")), "content_version": F.lit(version)})


def pending_content(df: DataFrame, version: str, force: bool = False, col: str = "content_version") -> DataFrame:
    return df if force else df.where(~F.col(col).eqNullSafe(F.lit(version)))


def prep_status(content: Column, image: Column, passed: Column, errored: Column) -> Column:
    """passed: the check's outcome, null where there was none."""
    return F.when(errored, "Error").when(content & image & F.coalesce(passed, F.lit(True)), "Ready").when(content & image, "QA Failed").when(content, "Content Done").when(image, "Image Done").otherwise("Not Started")


def publish_targets(df: DataFrame, keys: list[str] | None = None, limit: int | None = None) -> DataFrame:
    ok = F.col("selection_status").isin("Selected", "Initial Candidate", "New Arrivals Candidate", "Pinned")
    out = df.where(ok if not keys else F.col("product_key").isin(*keys)).orderBy(F.col("collection").asc_nulls_last(), F.col("product_score").desc_nulls_last(), "product_key")
    return out if limit is None else out.limit(limit)


def _code(c: Column) -> Column:
    return F.nullif(F.lower(F.btrim(c)), F.lit(""))


def match_listings(rows: DataFrame, listings: DataFrame) -> DataFrame:
    """Rows to store listings by barcode, and only where no barcode hits, by SKU; several listings stay, each once.

    rows: product_key, codes array<struct<barcode, sku>>; listings: listing_id, barcode, sku per variant.
    """
    mine = rows.select("product_key", F.explode("codes").alias("c")).select("product_key", _code(F.col("c.barcode")).alias("b"), _code(F.col("c.sku")).alias("s"))
    them = listings.select("listing_id", _code(F.col("barcode")).alias("lb"), _code(F.col("sku")).alias("ls"))
    hit = mine.join(them, F.col("b") == F.col("lb")).select("product_key", "listing_id", F.lit("barcode").alias("matched_by")).distinct()
    rest = mine.join(hit.select(F.col("product_key").alias("_h")).distinct(), F.col("product_key") == F.col("_h"), "left_anti")
    return hit.unionByName(rest.join(them, F.col("s") == F.col("ls")).select("product_key", "listing_id", F.lit("sku").alias("matched_by")).distinct())


def push_plan(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Per row and matched listing: would push, with the fields that have a value; else not imported. An image whose alt text is there is skipped.

    rows: product_key, title, description_html, tags, image, image_alt_text, alts (texts of the listing's images).
    """
    fields = F.array_compact(F.array(F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.lit("title")), F.when(F.coalesce(F.col("description_html"), F.lit("")) != "", F.lit("description")), F.when(F.coalesce(F.size("tags") > 0, F.lit(False)), F.lit("tags")), F.when(F.col("image").isNotNull() & ~F.coalesce(F.array_contains("alts", F.col("image_alt_text")), F.lit(False)), F.lit("image"))))
    met = rows.join(matches.select(F.col("product_key").alias("_k"), "listing_id"), F.col("product_key") == F.col("_k"), "left")
    found = F.col("listing_id").isNotNull()
    return met.select("product_key", "listing_id", F.when(found, "would-push").otherwise("not-imported").alias("action"), F.when(found, fields).otherwise(F.array().cast("array<string>")).alias("fields"))


