"""Connected components of a graph in a table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.llm.common import persist_plan


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges to (u, v) where v is the smallest node of u's component, for all other u.

    No neighbourhood is ever gathered: each step is a minimum per node, combined before the
    shuffle, and a join back on it. The steps grow with the logarithm of the longest path, and
    each is cut off with a checkpoint.
    """
    now = persist_plan(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = now.select(F.explode(ends).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(down, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v")
        now = persist_plan(small.filter("u <> v").distinct())
        at = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.countDistinct("u").alias("d")).first()
        if at["n"] == at["d"] and (at["n"], at["x"]) == mark:
            return now
        mark = (at["n"], at["x"])
