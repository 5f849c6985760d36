"""A training corpus from `documents`: toxicity, near duplicates, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written before the next one reads
it. All but the last return the columns of `documents`; further columns of the input are dropped,
and missing ones are an error. Null or empty texts pass every stage; an empty table gives an empty
result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortwise.llm import bpe, minhash, mixing, toxicity
from cohortwise.llm.common import documents, public_vocabulary, stored
from cohortwise.llm.suffixes import remove_repeated_bytes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are more likely toxic than not, by a model of the labelled ones."""
    docs = docs.select(COLUMNS)
    model = toxicity.fit(documents(spark, sf_dir, "labels"), docs)
    return toxicity.score(docs, model).where("p_toxic < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, 0.8), that with the least id; of repeated rows one."""
    return minhash.one_of_each(docs.select(COLUMNS), words=5, percent=80).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur elsewhere; a character cut in two goes as a whole.

    n_chars is the new length. Every document stays, if need be with an empty text.
    """
    cut = remove_repeated_bytes(docs.select(COLUMNS), characters=True)
    is_cut = F.size("removed_at") > 0
    text = F.when(is_cut, F.col("kept_bytes").cast("string")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.when(is_cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that each source has its share, in a random order."""
    return mixing.mix_sources(docs.select(COLUMNS)).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    coded = bpe.encode(docs.select(COLUMNS), *public_vocabulary())
    return coded.select(
        "doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        (F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mixing_sources", mix),
    ("byte_level_bpe", tokenize),
]

#: No SQL: an ordinal regression, minima of hashes and byte pairs are none of its operations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
