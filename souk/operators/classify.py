"""One collection per product: given subcategory, category fragment, keywords, catch-all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions import config as C


def category_hint(c: Column) -> Column:
    """Collection of the first fragment, in order, that a category text holds."""
    out = F.lit(None).cast("string")
    for fragment, name in reversed(C.CATEGORY_HINTS):
        out = F.when(F.contains(F.lower(c), F.lit(fragment)), name).otherwise(out)
    return out


def keyword_hits(low: str) -> dict[str, Column]:
    """Per collection, how many of its keywords a column of lower-case texts holds."""
    return {name: F.expr(" + ".join(f'CAST(contains({low}, "{w}") AS INT)' for w in words)) for name, words in C.KEYWORDS.items()}


def classify(df: DataFrame, cfg: C.Config, mapping: dict[str, str] | None = None) -> DataFrame:
    """Adds collection, confidence (DECIMAL(4,2)), method, needs_review. Ties between collections go by their fixed order."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    fixed = F.lit(None).cast("string")
    for k, v in (mapping or {}).items():
        fixed = F.when(F.col("subcategory") == k, v).otherwise(fixed)
    df = df.withColumn("_low", F.lower(F.concat_ws(" ", blank("product_name"), blank("subcategory"), blank("description"))))
    hits = keyword_hits("_low")
    names = {n: f"_h{i}" for i, n in enumerate(hits)}
    out = df.withColumns({"_fixed": fixed, "_hint": category_hint(F.concat_ws(" ", blank("category"), blank("subcategory"))), **{names[n]: h for n, h in hits.items()}})
    best = F.greatest(*[F.col(v) for v in names.values()])
    total = sum((F.col(v) for v in names.values()), F.lit(0))
    word = F.lit(None).cast("string")
    for n, v in reversed(names.items()):
        word = F.when(F.col(v) == best, n).otherwise(word)
    sure = F.bround((0.5 + 0.5 * F.try_divide(best, total)).cast("decimal(18,6)"), 2)
    how = F.when(F.col("_fixed").isNotNull(), "subcategory-map").when(F.col("_hint").isNotNull(), "category-map").when(best > 0, "keyword").otherwise("catch-all")
    conf = F.when(how == "subcategory-map", F.lit("0.95").cast("decimal(4,2)")).when(how == "category-map", F.lit("0.90").cast("decimal(4,2)")).when(how == "keyword", sure.cast("decimal(4,2)")).otherwise(F.lit("0.40").cast("decimal(4,2)"))
    out = out.withColumns({"collection": F.coalesce("_fixed", "_hint", F.when(best > 0, word), F.lit(C.CATCH_ALL)), "confidence": conf, "method": how})
    return out.withColumn("needs_review", F.col("method").isin("keyword", "catch-all") & (F.col("confidence") < cfg.minimum_confidence)).drop("_low", "_fixed", "_hint", *names.values())


def cache_key(mark: Column, model: str, version: str) -> Column:
    return F.concat_ws(":", mark, F.lit(model), F.lit(version))


def pending(df: DataFrame, cache: DataFrame, mark: str, model: str, version: str) -> DataFrame:
    """Rows that need review and have no answer in the cache (column ``cache_key``)."""
    asked = df.where("needs_review").withColumn("cache_key", cache_key(F.col(mark), model, version))
    return asked.join(cache.select(F.col("cache_key").alias("_c")), F.col("cache_key") == F.col("_c"), "left_anti")
