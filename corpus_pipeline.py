"""A training corpus from raw documents: filter, deduplicate, redact, mix, tokenize."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castloom.llm import mixing, pii, quality, queries, sentence_pieces, simhash
from castloom.llm.base import mark, parked, ready, sweep, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    ready(spark)
    return quality.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: fingerprints of five-word shingles that
    differ in four bits at most."""
    ready(spark)
    return simhash.keep_one(docs, words=5, distance=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the text; n_chars follows."""
    ready(spark)
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.length("text").cast(kind))
    return clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ready(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text."""
    ready(spark)
    model = sentence_pieces.read_model(queries.PIECE_MODEL)
    made = ("ids", "n_tokens", "parity", "round_trip")
    return sentence_pieces.encode(docs, model, made=made)


STAGES = [
    ("quality rules", quality_rules),
    ("near copies", near_copies),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("tokens", tokens),
]

#: The stages hash shingles, fit a model and read a vocabulary, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Each result is written before the next stage reads it;
    what a stage has parked, and its input, is deleted as soon as its result is there."""
    docs, start = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = parked(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, start, mark() - 1)
    return docs
