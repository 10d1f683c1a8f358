"""A training corpus from documents: each stage takes what its predecessor kept and hands on Parquet.

Toxic documents go, one document of each group of near-copies stays, personal data become pseudonyms, sources are mixed so
that no document is lost and none is used more than REPETITION times, and what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, mixing, ngram_join, pii, toxicity
from inkwell.llm.common import settle, table
from inkwell.llm.queries import RANKS, REPETITION, held_out, pii_key


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the machine rejects; it learns from the labels that aren't held out. Empty texts stay where most labels are 0."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), train_where=~held_out(F.col("id")))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")  # so that no column clashes
    return toxicity.score(whole, machine, keep=["row"]).where("predicted = 0").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group, one without an id only where none has one.

    Rows are told apart by id and text, so a repeated id drops nothing that differs; of equal rows one stays.
    """
    rows = docs.withColumn("__row", F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()))
    joined = ngram_join.ngram_jaccard_join(rows, id_col="__row").select("__row", "component_id").distinct()
    first = rows.select("doc_id", "__row").join(joined, "__row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("m"))
    return rows.join(first.select("m.__row"), "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites texts; n_chars follows, null for a null text."""
    return pii.pseudonyms(docs, pii_key(spark), counts=False).withColumn("n_chars", F.length("text").cast("bigint"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, up to REPETITION times their tokens; none is lost."""
    return mixing.mix(docs, repetition=REPETITION)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with digests of them and of what they decode to."""
    return bpe.encode(docs, public_tokenizers.path(RANKS), keep=["doc_id", "source", "lang"], decode=True)


STAGES = [("toxicity", toxic), ("near_copies", near_copies), ("personal_data", personal_data), ("mixture", mixture), ("encoded", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each reread from Parquet in the shared folder.

    Null and empty texts pass the filters, one of them stays of each id, and encode as no ids; without documents there are no
    rows. Columns beside those of documents are handed on until the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"stage-{name}")
    return docs
