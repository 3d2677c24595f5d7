"""The registered queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castloom.llm import (
    chunks,
    mixing,
    periodic_runs,
    pii,
    quality,
    sentence_pieces,
    sharding,
    simhash,
    spellings,
    suffixes,
    token_rollups,
    url_cascade,
    vptree,
)
from castloom.llm.base import scratch, table


#: The vocabulary file of query op5; SENTENCE_PIECE_MODEL in the environment names another one.
PIECE_MODEL = os.environ.get("SENTENCE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op4_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return vptree.search(vectors, F.col("vec_id") % 20 == 0)


def op5_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = sentence_pieces.read_model(PIECE_MODEL)
    return sentence_pieces.token_digests(table(spark, folder, "documents"), model)


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches over all documents: counts of two tokenizers; then the counts of texts
    with table bars, without the bars; then deletes of texts under ten words. The last two
    are applied twice, as after a lost driver."""
    docs = table(spark, folder, "documents")
    words, text = mixing.word_count(F.col("text")), F.coalesce("text", F.lit(""))
    bars = F.size(F.filter(mixing.words_of(F.col("text")), lambda w: w == "|"))
    quarters = F.call_function("div", F.length(text) + 3, F.lit(4))
    change = token_rollups.changes
    first = change(docs, token_rollups.INSERT, "words-1", words).unionByName(
        change(docs, token_rollups.INSERT, "quarters-1", quarters)
    )
    revised = change(docs.where("text like '%|%'"), token_rollups.REVISE, "words-1", words - bars)
    short = docs.where(words < 10)
    gone = change(short, token_rollups.DELETE, "words-1", words).unionByName(
        change(short, token_rollups.DELETE, "quarters-1", quarters)
    )
    rollup = token_rollups.Rollup(spark, scratch(spark, "rollup"))
    for batch, changes in ((1, first), (2, revised), (2, revised), (3, gone), (3, gone)):
        rollup.apply(batch, changes)
    return rollup.totals()


def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_cascade.judge(table(spark, folder, "pages"))


def op8_substring_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.dedupe(table(spark, folder, "documents")).drop("kept_text")


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.detect(table(spark, folder, "documents"))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents")).drop("kept")


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spellings.group(spellings.vocabulary(table(spark, folder, "documents"), noise=97))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, folder, "documents"))


def op13_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(table(spark, folder, "documents"), count=40)


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_quality_rules": op2_quality_rules,
    "op3_mix_sources": op3_mix_sources,
    "op4_nearest_vectors": op4_nearest_vectors,
    "op5_sentence_pieces": op5_sentence_pieces,
    "op6_token_counts": op6_token_counts,
    "op7_url_filters": op7_url_filters,
    "op8_substring_chunks": op8_substring_chunks,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_personal_data": op10_personal_data,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_shards": op13_shards,
}
ORACLES: dict[str, str] = {
    "op2_quality_rules": quality.JUDGE_SQL,
    "op3_mix_sources": mixing.MIX_SQL,
    "op4_nearest_vectors": vptree.SEARCH_SQL,
    "op6_token_counts": token_rollups.TOTALS_SQL,
    "op7_url_filters": url_cascade.JUDGE_SQL,
}
