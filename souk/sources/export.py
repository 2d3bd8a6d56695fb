"""Exports: declared column order, joined lists, no nulls; CSV and JSON by Spark's writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDIDATES = ("Initial Candidate", "New Arrivals Candidate", "Selected", "Pinned")


def export_frame(df: DataFrame, columns: list[str], now: str) -> DataFrame:
    """The columns in order as text, lists joined by ``; ``, nulls empty, and ``Exported At``."""
    kinds = {f.name: f.dataType for f in df.schema}
    cell = lambda c: F.array_join(F.col(c), "; ") if isinstance(kinds[c], T.ArrayType) else F.col(c).cast("string")
    return df.select(*[F.coalesce(cell(c), F.lit("")).alias(c) for c in columns], F.lit(now).alias("Exported At"))


def export_batches(batches: DataFrame, columns: list[str], now: str) -> DataFrame:
    """Selection batches as :func:`export_frame` has them, one row per batch."""
    return export_frame(batches, columns, now)


def export_csv(df: DataFrame, columns: list[str], path: str, now: str) -> None:
    export_frame(df, columns, now).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str, now: str) -> None:
    """Rows as JSON lines below ``path/rows``, and ``exported_at`` and ``count`` below ``path/manifest``."""
    df.write.json(f"{path}/rows")
    manifest(df, now).write.json(f"{path}/manifest")


def manifest(df: DataFrame, now: str) -> DataFrame:
    return df.agg(F.count("*").alias("count")).select(F.lit(now).alias("exported_at"), "count")


def candidates(df: DataFrame, status: str = "selection_status") -> DataFrame:
    return df.where(F.col(status).isin(*CANDIDATES))
