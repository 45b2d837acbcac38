"""Readers and writers with explicit schemas. Nothing infers a schema from data."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.functions.scalars import slug


def read_table(spark: SparkSession, path: str, schema: str, source: str | None = None) -> DataFrame:
    """CSV with a header; ``source`` tags each row."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df if source is None else df.withColumn("source", F.lit(source))


def read_many(spark: SparkSession, directory: str, suffix: str, schema: str) -> DataFrame:
    """All CSV files of a directory with a suffix; empty placeholders give no rows."""
    return spark.read.schema(schema).option("pathGlobFilter", f"*{suffix}").csv(directory, header=True)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system that the path belongs to, whatever it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_regimes(spark: SparkSession, paths: Mapping[str, str], regimes: Sequence[str], schema: str, strict: bool = False) -> DataFrame:
    """Rows of the regimes' files with a regime column; missing files are skipped unless ``strict``."""
    unknown = [r for r in regimes if r not in paths]
    if unknown:
        raise ValueError(f"unknown regimes: {unknown}")
    out = None
    for r in regimes:
        if not exists(spark, paths[r]):
            if strict:
                raise FileNotFoundError(paths[r])
            continue
        df = read_json_array(spark, paths[r], schema).withColumn("regime", F.lit(r))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return spark.createDataFrame([], f"{schema}, regime string") if out is None else out


def read_chart_csv(spark: SparkSession, path: str) -> DataFrame:
    """(time, value) of a CSV whose headers may be padded and in any case.

    The first of timestamp, date and time is the time column; rows that don't parse are dropped.
    """
    df = spark.read.csv(path, header=True)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    time = next((c for c in ("timestamp", "date", "time") if c in df.columns), None)
    if time is None or "value" not in df.columns:
        raise ValueError("no time or value column")
    out = df.select(F.try_to_timestamp(F.regexp_replace(time, "T", " ")).alias("time"), F.col("value").try_cast("double").alias("value"))
    return out.dropna()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_records(df: DataFrame, path: str) -> None:
    """JSON arrays of records, one for each partition: every file is read by ``read_json_array``."""
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("r"))

    def arrays(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = False
        for p in parts:
            if len(p):
                yield pd.DataFrame({"value": [("," if opened or i else "[") + r for i, r in enumerate(p["r"])]})
                opened = True
        if opened:
            yield pd.DataFrame({"value": ["]"]})

    rows.mapInPandas(arrays, "value string").write.mode("overwrite").text(path)


def write_partitioned(df: DataFrame, path: str, key: str) -> None:
    """One folder for each value of the key, named by its slug; the rows are spread by it first."""
    out = df.withColumn("slug", slug(F.col(key)))
    out.repartition("slug").write.mode("overwrite").partitionBy("slug").parquet(path)
