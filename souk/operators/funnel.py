"""The initial funnel: rank everything bare, enrich the best, score suppliers, score again, and give what can be selected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions import config as C
from souk.operators import scoring, selection, upsert
from souk.session import written


def run(products: DataFrame, suppliers: DataFrame, details: DataFrame, fields: list[str], cfg: C.Config, top: int = 120, per_supplier: int = 4, high: float | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The final pool of candidates, and the rows of each stage by name, written where they are read again.

    Suppliers are unknown at first, so products are ranked on their own; the best
    ``top`` of them, at most ``per_supplier`` of one supplier and none above the
    price ``high``, get their details; then suppliers are scored and all products
    again.
    """
    unknown = suppliers.limit(0).withColumns({"eligibility": F.lit(""), "supplier_score": F.lit(0).cast("decimal(5,1)")})
    # some 80 patterns a row: a table of few bytes is one file split, so its rows are dealt to all cores
    bare = written(scoring.score_products(products.repartition("product_key"), unknown, None, cfg))
    short = F.col("review_status") == "Shortlisted"
    ok = short if high is None else short & (F.col("retail_price") <= high)
    best = written(selection.pick_targets(bare, "supplier_key", "product_score", "product_key", per_supplier, top, where=ok).select("product_key"))
    found = details.join(best.select(F.col("product_key").alias("_b")), F.col("product_key") == F.col("_b"), "left_semi")
    richer = upsert.enrich(products, found, "product_key", fields)
    final = written(scoring.score_products(richer, scoring.score_suppliers(suppliers, cfg), None, cfg))
    pool = selection.build_candidates(final, high=high)
    return pool, {"scanned": bare, "preranked": bare.where(short), "enriched": best, "shortlisted": final.where(short), "candidates": pool}


def counts(stages: dict[str, DataFrame]) -> DataFrame:
    """``stage``, ``n``."""
    out = None
    for name, df in stages.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out
