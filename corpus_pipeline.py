"""A corpus from raw documents: toxic texts go, copies go, sources are mixed, texts become token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a frame, which is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegeo.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from tablegeo.llm.common import bound_batches, hidden, materialize
from tablegeo.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted to the labelled ones, scores below one half."""
    bound_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = hidden("toxicity", docs)
    return docs.withColumn(score, toxicity.scored("text", model)["score"]).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that agrees but for white space."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of similar ones."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources weigh alike, in shuffled order."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    bound_batches(spark)
    path = tokenizer_path()
    coded = docs.select("doc_id", "lang", "source", "text", bpe.round_trip("text", path).alias("both"))
    back = coded.select("doc_id", "lang", "source", "text", F.col("both.ids").alias("token_ids"), "both.decoded")
    return back.select("doc_id", "lang", "source", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("decodes"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: SQL cannot express a learned toxicity model; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
