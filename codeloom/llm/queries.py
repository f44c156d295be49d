"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import _common as C
from codeloom.llm import embeddings, mixing, packing, pii, quality_model, quality_rules, simhash, substrings, token_blocks, warc


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(C.table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_files(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(C.table(spark, sf_dir, "documents"), keep=["doc_id"])
    of = lambda i: F.filter("base_spans", lambda x: x["kind"] == i)
    counts = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(C.table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_copies(C.table(spark, sf_dir, "documents"))
    pairs = F.sequence(F.lit(0), F.size("removed") - 2, F.lit(2))
    size = F.aggregate(F.when(F.size("removed") > 0, pairs).otherwise(F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, i: a + F.get("removed", i + 1) - F.get("removed", i))
    return out.select("doc_id", "n_bytes", size.alias("n_removed"), (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
g AS (SELECT payload_digest AS gd, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d LEFT JOIN g ON gd = payload_digest
"""


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT vec_id, CAST(count(l.b) AS BIGINT) AS n_links FROM embeddings LEFT JOIN l ON vec_id = l.a GROUP BY vec_id),
m AS (SELECT vec_id, least(vec_id, coalesce(min(r.b), vec_id)) AS component_id FROM embeddings LEFT JOIN r ON vec_id = r.a GROUP BY vec_id)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c JOIN m USING (vec_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_warc, op3_quality_rules, op4_token_blocks, op5_quality_model, op6_pii, op7_embeddings, op8_packing, op9_simhash, op10_substrings)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op7_embeddings": OP7_SQL}
