"""Documents to training tokens: quality, near duplicates, benchmark leaks, source mix, token shards.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes every
stage's result to the shared folder, reads it back as the next one's input and
deletes what the stage needed meanwhile.

All stages read whole texts, return an empty frame for an empty one, and pass other
columns through untouched, whatever their names; the last one returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm import decontam, mixing, neardup, quality, tokens
from wattline.llm.common import Scratch, clear_scratch, n_words, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule passes.

    Null and empty texts have too few words and go; repeated rows are judged alike, one by one.
    """
    return quality.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8.

    The smallest id of a group stays.  Rows with a null id all stay; of rows that share an id
    one stays, whatever their texts; texts without words are like nothing else and stay.
    """
    return neardup.deduplicated(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Null texts hold none; null items and those of fewer than five tokens are no passages.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them, at most twice.

    Texts without words are never taken; a null source is one of its own, last in order; rows
    with null or equal ids are documents of their own, ordered by hash, id and size.
    """
    return mixing.mixed(docs, F.array("source"), n_words(F.col("text")))


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids in the token shards.

    Null ids come first; rows with equal ids (repeats of the mix) follow each other by text.
    """
    import public_tokenizers

    return tokens.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token shards", token_shards),
]

#: Near-duplicate components and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the caller may ``clear_scratch`` once the result is consumed."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        made = len(Scratch.made)
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(docs, str(k))
            clear_scratch(made)
            if k:
                scratch.drop(str(k - 1))
    return docs
