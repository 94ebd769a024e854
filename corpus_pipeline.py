"""From raw documents to token ids: quality, exact copies, near copies, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; :func:`run` writes every
stage's result to the session's shared folder and reads it again.  All stages but the last return the
columns of ``documents``.  Names that begin with two underscores are the stages' own; other extra columns
pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from csvloom.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality_zstd
from csvloom.llm.common import keep_rows, stage, text_key
from csvloom.llm.queries import KEEP_SCORE, RANKS, WEIGHTS

#: Near copies: word n-grams and percent of similarity.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    model = quality_zstd.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_zstd.rate_rows(docs, model, name="__score").where(F.col("__score") >= KEEP_SCORE).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    rated = exact_dedup.exact_dedup(docs)  # texts that nobody shares have no hash and are not looked for
    return keep_rows(docs, rated.select("doc_id", F.unhex(F.substring("full_hash", 1, 32)).alias("th"), "kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return keep_rows(docs, ngram_join.jaccard_components(docs, n=NEAR_WORDS, percent=NEAR_PERCENT, keys=True))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in order of training position."""
    columns = docs.columns
    none = F.lit("null")
    # rows that share a key are told apart by their number, so that each meets its own part of the mix
    keyed = docs.withColumn("__k", text_key(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), none), F.coalesce("source", none), F.hex(text_key(F.col("text"))))))
    alike = Window.partitionBy("__k")
    numbered = keyed.withColumn("__n", F.row_number().over(alike.orderBy("__k")))
    taken = mixing.curriculum_mix(keyed, WEIGHTS, carry=["__k"]).where("taken > 0").select(
        F.col("__k").alias("__mk"), F.col("position").alias("__position"), F.col("pass").alias("__pass"), F.col("taken").alias("__taken"), "copies"
    )
    placed = taken.withColumn("__mn", F.row_number().over(Window.partitionBy("__mk", "__pass").orderBy(F.desc("copies"), "__position"))).drop("copies")
    same = (F.col("__k") == F.col("__mk")) & (F.col("__n") <= F.col("__mn")) & (F.col("__n") >= F.col("__mn"))
    return mixing.in_training_order(numbered.join(placed, same), prefix="__").select(*columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit) and their number."""
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix", mix), ("tokens", tokens)]

#: Compression, and the merges of the ranks, are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
