"""A training corpus from ``documents``: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import bpe, common, langid, mixing, pii, simhash

#: The last stage and the rejection by language can't be written in SQL.
ORACLE_SQL = None
#: A language is accepted from this score on.
SURE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or with an unsure language go. Fills null ``lang``."""
    net = langid.train(docs.where(~langid.held_out()))
    seen = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    told = langid.identify(seen, net, "doc.text").where((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return told.select(*((F.coalesce("doc.lang", "lang_pred") if c == "lang" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked in the text; ``n_chars`` follows the text."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are drawn for the target weights."""
    return mixing.mix(docs).where("chosen").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_decode(docs, keep=("ids",))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
