"""From raw documents to packed sequences: five stages, each one operator of ``souk.llm``.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again for the next one. All but the last keep the columns
of documents; extra columns, of any name, stay with their rows. Null and empty
texts pass the first stage, are copies of each other in the second, have no words
in the third and no tokens in the fourth, and are an end id alone in the last;
null ids keep their rows as each stage's operator says; an empty table stays
empty. Rows that repeat are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from souk.llm import mixing, overlap, packing, substring, toxicity
from souk.llm.common import Workspace, opened, release


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, _labels(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose 5-word shingles overlap by 0.8 or more.

    SimHash by pigeonhole names candidates as in op2; since at 0.8 fingerprints of
    64 bits differ too much for it, the sets' heads name the rest, and the sets decide.
    """
    return overlap.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.strip_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rare domains are repeated up to their targets; nothing is dropped."""
    return mixing.mixed(docs, _labels(spark, sf_dir), least=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies), ("substring dedup", cut_repeats), ("mixing to targets", mix), ("best-fit packing", pack)]

#: A trained classifier and a packing cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, docs, before = Workspace(spark), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        mark = opened()
        docs = ws.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, mark)  # what the stage has written on its way
        if before is not None:
            ws.drop(before)
        before = docs
    return docs
