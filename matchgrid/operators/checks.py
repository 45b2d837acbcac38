"""Data-quality operators: each gives a table (check, ok, detail)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType


def _row(df: DataFrame, check: str, bad: Column) -> DataFrame:
    """One row from one aggregate that counts what is bad."""
    return df.agg(F.coalesce(bad, F.lit(0)).cast("long").alias("bad")).select(F.lit(check).alias("check"), (F.col("bad") == 0).alias("ok"), F.col("bad").cast("string").alias("detail"))


def check_schema(df: DataFrame, target: StructType) -> DataFrame:
    """Names, order, count and types against a target; only schemas are compared, no data is read."""
    have, want = df.schema, target
    names, wanted = have.fieldNames(), want.fieldNames()
    types = [n for n in wanted if n in names and have[n].dataType != want[n].dataType]
    rows = [
        ("count", len(names) == len(wanted), f"{len(names)} of {len(wanted)}"),
        ("missing", not set(wanted) - set(names), ",".join(sorted(set(wanted) - set(names)))),
        ("extra", not set(names) - set(wanted), ",".join(sorted(set(names) - set(wanted)))),
        ("order", [n for n in names if n in wanted] == [n for n in wanted if n in names], ""),
        ("types", not types, ",".join(types)),
    ]
    one = df.sparkSession.range(1)
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("check"), F.lit(b).alias("ok"), F.lit(c).alias("detail")) for a, b, c in rows])).alias("r")).select("r.*")


def check_file_schemas(spark: SparkSession, files: Sequence[str], target: StructType, through_spark: bool = False) -> DataFrame:
    """(file, column, problem): where the files of a table differ from a target, from their footers.

    A folder stands for all Parquet files below it. Problems are missing, extra, type (with both types) and
    order (of a file whose columns are all there, but in another order). Spark lists the files and
    deals them to tasks; a task opens its files by itself and reads their footers only. With
    ``through_spark`` Spark hands over whole files instead, for stores that only it can open. No
    footer passes through the driver.
    """
    names = [f.name for f in target]
    wanted = {f.name: f.dataType.simpleString() for f in target}
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(list(files))
    found = found.select("path", "content") if through_spark else found.select("path").repartition("path")

    def footer(row: dict) -> pa.Schema:
        if through_spark:
            return pq.read_schema(pa.BufferReader(row["content"]))
        store, path = FileSystem.from_uri(re.sub("^file:/+", "/", row["path"]))
        return pq.read_schema(path, filesystem=store)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                path, have = row["path"], {f.name: from_arrow_type(f.type, prefer_timestamp_ntz=True).simpleString() for f in footer(row)}
                rows += [(path, c, "missing") for c in names if c not in have] + [(path, c, "extra") for c in have if c not in wanted]
                rows += [(path, c, f"type {have[c]} for {wanted[c]}") for c in names if c in have and have[c] != wanted[c]]
                if list(have) != names and set(have) == set(names):
                    rows.append((path, None, "order"))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["file", "column", "problem"])

    return found.mapInArrow(compare, "file string, column string, problem string")


def check_no_new_nulls(df: DataFrame, before: str, after: str) -> DataFrame:
    """Values that were there before parsing and are null after it."""
    return _row(df, "no_new_nulls", F.count_if(F.col(before).isNotNull() & F.col(after).isNull()))


def check_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Values outside the closed range; null passes."""
    return _row(df, f"range_{column}", F.count_if(~F.col(column).between(low, high)))


def check_duplicates(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Surplus rows by key, or over whole rows."""
    counts = df.groupBy(*(keys or df.columns)).count()
    return _row(counts, "duplicates", F.sum(F.col("count") - 1))


def check_sums_preserved(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each column: its sums before and after agree to a millionth."""
    a = before.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in columns])
    b = after.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(f"{c}_after") for c in columns])
    rows = F.array(*[F.struct(F.lit(f"sum_{c}").alias("check"), (F.abs(F.col(c) - F.col(f"{c}_after")) <= 1e-6 * F.greatest(F.abs(F.col(c)), F.lit(1.0))).alias("ok")) for c in columns])
    return a.join(F.broadcast(b)).select(F.explode(rows).alias("r")).select("r.*")  # one row by one row


def check_expected_counts(df: DataFrame, keys: Sequence[str], expected: int, distinct: str | None = None) -> DataFrame:
    """One row for each group: its rows (or distinct values) against the expected number."""
    n = F.countDistinct(distinct) if distinct else F.count("*")
    return df.groupBy(*keys).agg(n.alias("n")).select(*keys, "n", (F.col("n") == expected).alias("ok"))


def check_pairing(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of either side that the other lacks, and keys that repeat on a side."""
    x, y = a.groupBy(*keys).agg(F.count("*").alias("na")), b.groupBy(*keys).agg(F.count("*").alias("nb"))
    both = x.join(y, list(keys), "full")
    return both.agg(F.count_if(F.col("nb").isNull()).alias("only_a"), F.count_if(F.col("na").isNull()).alias("only_b"), F.count_if((F.col("na") > 1) | (F.col("nb") > 1)).alias("repeated"))


def check_coverage(everything: DataFrame, covered: DataFrame, key: str, warn_below: float) -> DataFrame:
    """Share of the keys that the other table covers, in percent."""
    seen = covered.select(key).distinct().withColumn("seen", F.lit(1))
    out = everything.select(key).distinct().join(seen, key, "left").agg(F.count("*").alias("n"), F.count("seen").alias("covered"))
    pct = F.try_divide(F.col("covered") * 100.0, F.nullif(F.col("n"), F.lit(0)).cast("double"))
    return out.select("n", "covered", pct.alias("pct"), F.coalesce(pct >= warn_below, F.lit(False)).alias("ok"))


def check_constant(df: DataFrame, key: str, column: str) -> DataFrame:
    """Groups that hold more than one value of a column that should be constant."""
    counts = df.groupBy(key).agg(F.countDistinct(column).alias("n"))
    return _row(counts, f"constant_{column}", F.count_if(F.col("n") > 1))


def check_inner_gap(df: DataFrame, key: str, season: str, first: int, last: int) -> DataFrame:
    """Keys with seasons before and after a span that miss some of the span, with what is missing."""
    seen = df.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col(season).between(first, last), F.col(season)))).alias("seen"), F.max((F.col(season) < first).cast("int")).alias("b"), F.max((F.col(season) > last).cast("int")).alias("a"))
    missing = F.array_except(F.sequence(F.lit(first), F.lit(last)), F.col("seen"))
    return seen.filter("a = 1 and b = 1").withColumn("missing", missing).filter(F.size("missing") > 0).select(key, "missing")


def check_parts_total(whole: DataFrame, *parts: DataFrame) -> DataFrame:
    """Rows of the whole against the sum over its parts."""
    n = whole.agg(F.count("*").alias("whole"))
    total = None
    for p in parts:
        one = p.agg(F.count("*").alias("n"))
        total = one if total is None else total.unionAll(one)
    total = total.agg(F.sum("n").alias("parts"))
    return n.join(F.broadcast(total)).select("whole", "parts", (F.col("whole") == F.col("parts")).alias("ok"))  # one row by one row


def check_single_parent(df: DataFrame, key: str, parent: str) -> DataFrame:
    """Keys under more than one parent, with the list of them."""
    sets = df.groupBy(key).agg(F.array_sort(F.collect_set(parent)).alias("parents"))
    return sets.filter(F.size("parents") > 1)


def check_required(df: DataFrame, group: str, columns: Sequence[str], least: int) -> DataFrame:
    """For each group: its size against a minimum, and empty values of required columns."""
    empties = [F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"empty_{c}") for c in columns]
    out = df.groupBy(group).agg(F.count("*").alias("n"), *empties)
    ok = F.col("n") >= least
    for c in columns:
        ok = ok & (F.col(f"empty_{c}") == 0)
    return out.withColumn("ok", ok)


def check_bounds(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """(keys, rule): one row for each rule that a record breaks; a rule of null passes."""
    broken = F.filter(F.array(*[F.when(~cond, F.lit(name)) for name, cond in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(broken).alias("rule"))


def check_missing(df: DataFrame, column: str) -> DataFrame:
    return _row(df, f"missing_{column}", F.count_if(F.col(column).isNull()))
