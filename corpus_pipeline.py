"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm import decontam, line_dedup, mixing, near_dedup, toxicity
from matchgrid.llm.common import WORD, read, unused

#: Documents of this toxicity or more go.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold. The classifier learns from labels outside the held-out fold."""
    machine = toxicity.fit(docs, read(spark, sf_dir, "labels"), F.crc32(F.col("i").cast("string")) % 5 != 0)
    (score,) = unused(docs, "toxicity")
    return toxicity.score_toxicity(docs, machine, out=score).filter(F.col(score) < TOXIC).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier in the corpus; documents that lose all words go."""
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    cut = line_dedup.dedup_lines(docs)
    left = cut.filter((F.col("n_dropped") == 0) | has_words)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    (leaks,) = unused(docs, "leaks")
    return decontam.find_leaks(docs, read(spark, sf_dir, "benchmark"), out=leaks).filter(F.size(leaks) == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix in training order, with copies and positions."""
    return mixing.in_training_order(mixing.mix(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]
#: No SQL: a trained classifier and sampled signatures stand in between; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
