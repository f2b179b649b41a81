"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame
that is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, fm_index, simhash, toxicity
from tessera.llm.common import forget, others, table, written

#: The rank file of the tokenizer; a parameter of the last stage.
RANKS = "file://" + public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go.

    Null and empty texts score as texts without toxic words; without labels of both kinds all stay (the score
    is the share of toxic labels); equal rows share a score; an empty table gives no rows.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Null and empty texts are copies of each other; rows with the same id and text stay or go together; a null
    id is larger than any other; an empty table gives no rows.
    """
    return simhash.keep_one(docs, size=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 or more words that an earlier document has go; texts without any stay as they are.

    Null stays null, with its n_chars; rows with equal ids remove nothing from each other; rows with a null id
    neither lose nor remove anything; an empty table gives no rows.
    """
    rest = F.struct(*others(docs.columns, "text")).alias("row")
    cut = fm_index.dedup(docs.select("doc_id", "text", rest))
    gone = F.col("n_removed") > 0
    new = {"text": F.when(gone, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(gone, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go.

    Null and empty texts are clean; equal rows are judged alike; an empty table, or benchmark, loses nothing.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to the text's bytes.

    Null is encoded as the empty text, without ids; equal rows get equal ids; an empty table gives no rows.
    """
    coded = bpe.encode(docs, RANKS, PATTERN, decoded="decoded")
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", to_ids),
]

#: SQL expresses neither the fitted score nor the fingerprints; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)
        before = docs
    return docs
