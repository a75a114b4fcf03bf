"""The queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, arrowfile, bpe, lm, mixing, pieces, quality, simhash, toxicity, webp
from .common import fold_of, stored


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's vocabulary; operators take it as a parameter."""
    return public_tokenizers.path(name)


def split_pattern() -> str:
    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_labels(spark: SparkSession, sf_dir: str, label: str, name: str) -> DataFrame:
    """(doc_id, label) outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias(name))
    return labels.where(F.col(name).isNotNull() & (fold_of("doc_id") != 1))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(table(spark, sf_dir, "documents"), training_labels(spark, sf_dir, "toxic", "label"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    return quality.fit(table(spark, sf_dir, "documents"), training_labels(spark, sf_dir, "quality", "grade"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    held_out = F.coalesce(fold_of("doc_id") == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "threshold", "rejected")


def op2_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), k=10)


def op3_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_digests(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), split_pattern())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=3)


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document, by ``labels.quality``."""
    rated = quality.rate_documents(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir), grade=1)
    held_out = F.coalesce(fold_of("doc_id") == 1, F.lit(False))
    return rated.select("doc_id", held_out.alias("held_out"), "expected_grade", "tail", "selected")


def op7_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrowfile.packed_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = mixing.part_of(F.coalesce(F.col("doc_id").cast("string"), F.col("text")))
    sized, _ = stored(docs.select("doc_id", "source", mixing.word_count("text").alias("size"), part.alias("part")), "sizes")
    mixed = mixing.with_copies(sized, "doc_id", "source", F.col("size"), weights=(3, 1, 2), share=1.5, most=2.0, part=F.col("part"))
    return mixed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by how near they are to the benchmark's passages."""
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    return lm.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), path, split_pattern(), vocabulary=50_256)


def op10_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.count_pieces(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_toxicity,
        op2_multiprobe_neighbours,
        op3_lossless_webp,
        op4_byte_bpe,
        op5_simhash,
        op6_ordinal_quality,
        op7_arrow_sequences,
        op8_systematic_mix,
        op9_cross_entropy_difference,
        op10_piece_counts,
    )
    return {f.__name__: f for f in named}


OP8_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sums AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
    FROM sized GROUP BY source
), weighted AS (
    SELECT source, source_size, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
           2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS everything
    FROM sums
), levels AS (
    SELECT *, (1.5::DOUBLE * everything - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighted
), capped AS (
    SELECT *, level * weight >= cap AS full_up, max(CASE WHEN level * weight < cap THEN level END) OVER () AS common FROM levels
), targets AS (
    SELECT source, source_size, CASE WHEN full_up THEN cap ELSE common * weight END AS target,
           ('0x' || substr(md5('mix' || CASE WHEN source IS NULL THEN 'true' ELSE 'false' END || '/' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS moved
    FROM capped
), stepped AS (
    SELECT doc_id, source, size, CASE WHEN size = 0 THEN -1 ELSE (length(bin(size)) - 1) * 16 + (size * 16) // (1::BIGINT << (length(bin(size)) - 1)) - 16 END AS step,
           substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 2) AS part
    FROM sized
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY step, part, doc_id NULLS FIRST, size) AS pos FROM stepped
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (floor(pos * rate + moved) - floor((pos - 1) * rate + moved)))::BIGINT AS taken
FROM (SELECT p.*, t.source_size, t.target, t.moved, CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate
      FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_systematic_mix": OP8_SQL}
