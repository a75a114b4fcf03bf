"""A corpus pipeline of five stages over ``documents``.

Each stage takes what the one before kept, written as Parquet and read again.
The first four return the columns of ``documents``:

1. toxicity: documents whose score reaches their language's threshold go;
2. quality: documents whose chance of grade 1 is under one half go;
3. near_duplicates: one document of each component of near copies stays: those
   whose five-word shingles are alike by 0.8 or more, or whose SimHashes differ
   in at most 3 bits;
4. mix: each document comes as often as its source's target takes it;
5. bpe: token ids and their decoded bytes, as digests.

The classifiers are fitted on ``labels`` of the same folder, outside the
held-out fold. Null texts are empty texts throughout; empty tables pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import bpe, mixing, nearcopies, quality, toxicity
from shardloom.llm.common import configure, fresh_path, remove, stored, text_of, workspace
from shardloom.llm.queries import quality_model, split_pattern, tokenizer_file, toxicity_model

#: Least chance of the wanted grade to stay.
LEAST_TAIL = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    model = toxicity_model(spark, sf_dir)
    score = toxicity.score_column(spark, text_of("text"), model)
    return docs.withColumn("__score", score).where(F.col("__score") < toxicity.threshold_column(F.col("lang"), model)).drop("__score")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    model = quality_model(spark, sf_dir)
    valued = docs.withColumn("__value", quality.value_column(spark, text_of("text"), model))
    return valued.where(quality.tail_column(F.col("__value"), model, 1) >= LEAST_TAIL).drop("__value")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.without_near_copies(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    size, part = mixing.word_count("text"), mixing.part_of(F.coalesce(F.col("doc_id").cast("string"), F.col("text")))
    sized, _ = stored(docs.select("source", size.alias("__size"), part.alias("__part")), "sizes")
    return mixing.emitted(mixing.with_copies(docs, "doc_id", "source", size, part=part, counted=sized))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), split_pattern())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mix", mix_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot express the classifiers, SimHash or BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is a table of the shared folder, which goes once the next is there."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with workspace(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
