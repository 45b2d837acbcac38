"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def persist_plan(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint in the folder that all executors share.

    The folder is the one in spark.checkpoint.dir. A session that names none gets a folder of its
    own only where driver and executors are one process or share the machine; on a cluster it is
    an error, as a folder of one machine is lost with it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "matchgrid-checkpoints"))
    return df.checkpoint()


#: Keys of this many rows (of about 200 bytes: 50 MB) at most are broadcast; more are shuffled.
SMALL_ROWS = 250_000


def matching(left: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``left`` that the distinct, checkpointed ``keys`` name.

    Few keys are broadcast, so that the rows that don't match stay where they are. With many, a
    key of very many rows makes a skewed join, of which adaptive execution splits the left side.
    """
    return left.join(F.broadcast(keys) if keys.count() <= SMALL_ROWS else keys, on, "left_semi")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(*cols: Column) -> Column:
    """128-bit content key of a row as lowercase hex; nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in cols]
    return F.md5(F.concat_ws("\x1f", *parts))


def put(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with the columns added; columns of the same names, in any case, are replaced."""
    taken = {name.lower() for name in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(name) for name, c in columns.items()])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it from being a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
