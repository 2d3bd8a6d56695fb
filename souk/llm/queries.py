"""The registered queries of this subpackage and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from souk.llm import align, counts, langid, merkle, mixing, packing, repair, sharding, simhash, substring, toxicity, vptree, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_and_next(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), queries=F.col("id") % 20 == 0)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), ("doc_id",), F.octet_length("text"), SHARD_BYTES)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_report(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {"op2_simhash": op2_simhash, "op5_best_fit_packing": op5_best_fit_packing, "op10_substring_dedup": op10_substring_dedup, "op8_merkle": op8_merkle, "op7_toxicity": op7_toxicity, "op9_language": op9_language, "op3_warc": op3_warc, "op6_nearest": op6_nearest, "op1_sharding": op1_sharding, "op4_mixing": op4_mixing, "op11_token_counts": op11_token_counts, "op12_token_alignment": op12_token_alignment, "op13_conversation_repair": op13_conversation_repair, "pipeline": corpus_pipeline.run}


SHARD_BYTES = 1 << 20

OP1_SQL = f"""
WITH r AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\\N')), 1, 15))::BIGINT AS h FROM documents),
d AS (SELECT unnest(range(0, 49))::INT AS depth),
s AS (SELECT depth, h >> (60 - depth) AS prefix, sum(bytes)::BIGINT AS b, count(*) AS n FROM r, d GROUP BY ALL),
c AS (SELECT r.doc_id, r.bytes, s.*, row_number() OVER (PARTITION BY r.doc_id ORDER BY s.depth) AS k
      FROM r JOIN s ON s.prefix = r.h >> (60 - s.depth) WHERE s.b <= {SHARD_BYTES} OR s.depth = 48)
SELECT doc_id, bytes, CASE depth WHEN 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth) END AS shard,
       depth, 0 AS page, b AS shard_bytes, n AS shard_rows FROM c WHERE k = 1
"""

OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first_page FROM d WHERE n >= 100 GROUP BY h)
SELECT d.page_id, n AS payload_bytes, d.h AS payload_digest,
       CASE WHEN f.first_page <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_page <> d.page_id THEN f.first_page END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h AND d.n >= 100
"""


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
m AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM s),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM m) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
p AS (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT p.doc_id, string_agg(v, ' ' ORDER BY p.p) AS kept, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def oracle_sql() -> dict:
    return {"op1_sharding": OP1_SQL, "op3_warc": OP3_SQL, "op10_substring_dedup": OP10_SQL}
