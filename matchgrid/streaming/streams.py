"""Structured Streaming forms of the trade metrics, and restart-safe ingestion."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def stream_trade_metrics(fills: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Trade metrics per symbol and event-time window, for append mode: a window is given out once,
    when the greatest time seen is past its end by the delay, and its state is dropped then. Fills
    of windows that are gone are dropped; ``split_late`` keeps them apart.
    """
    buy, q, p = F.col("taker_side") == "BUY", F.col("quantity"), F.col("price")
    out = fills.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "symbol")
    out = out.agg(F.count("*").alias("trades"), F.sum(q).alias("volume"), F.sum(F.when(buy, q).otherwise(0)).alias("buy_volume"), F.try_divide(F.sum(p * q), F.sum(q).cast("double")).alias("vwap"), F.max_by("price", F.struct("time_ns", "event_id")).alias("last_price"))
    return out.select(F.col("w.start").alias("start"), "symbol", "trades", "volume", "buy_volume", "vwap", "last_price")


def split_late(stream: DataFrame, folder: str, window: str = "1 hour", delay: str = "10 minutes", time: str = "ts") -> StreamingQuery:
    """Parts a stream into ``folder``/on_time and ``folder``/late, by batch.

    Late are rows whose window ended a delay or more before the greatest time of all earlier
    batches (and rows without a time): just those that a windowed aggregate with this delay
    has no state for any more. A batch that runs again after a failure writes its own part anew,
    so each row stands in one of both once.
    """
    spark = stream.sparkSession

    def part(batch: DataFrame, i: int) -> None:
        seen = spark.read.schema("greatest timestamp, batch long").parquet(f"{folder}/seen") if i else None
        greatest = seen.filter(F.col("batch") < i).agg(F.max("greatest")).first()[0] if seen else None
        known = F.coalesce(F.col(time), F.timestamp_seconds(F.lit(0)))  # window() drops rows without a time
        gone = F.lit(False) if greatest is None else F.window(known, window)["end"] <= F.lit(greatest) - F.expr(f"interval {delay}")
        marked = batch.withColumn("_late", gone | F.col(time).isNull()).persist()
        try:
            for name, which in (("on_time", "not _late"), ("late", "_late")):
                marked.filter(which).drop("_late").write.mode("overwrite").parquet(f"{folder}/{name}/batch={i}")
            marked.agg(F.max(time).cast("timestamp").alias("greatest")).write.mode("overwrite").parquet(f"{folder}/seen/batch={i}")
        finally:
            marked.unpersist()

    return stream.writeStream.foreachBatch(part).option("checkpointLocation", f"{folder}/split").trigger(availableNow=True).start()


def windows_and_late(stream: DataFrame, folder: str, build: Callable[[DataFrame], DataFrame] = stream_trade_metrics, window: str = "1 hour", delay: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """Runs a windowed aggregate over what is there now, and returns its windows so far and the late
    rows so far. Running it again with the same folder goes on where it stopped."""
    spark = stream.sparkSession
    split_late(stream, folder, window, delay).awaitTermination()
    on_time = spark.readStream.schema(stream.schema).parquet(f"{folder}/on_time/*")
    out = build(on_time)
    append_to_table(out, folder)
    return spark.read.schema(out.schema).parquet(f"{folder}/result").drop("batch"), spark.read.schema(stream.schema).parquet(f"{folder}/late").drop("batch")


def append_to_table(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Writes what each batch gives out to ``folder``/result, a part for each batch, until nothing is left to read."""

    def keep(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={i}")

    running = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    running.awaitTermination()


TOTALS = "event_id bigint, symbol bigint, total_trades bigint, total_volume bigint"


class _Totals(StatefulProcessor):
    """Counts of a symbol so far, given out after each fill; forgotten when idle for the time to live."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "trades bigint, volume bigint", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        trades, volume = self.totals.get() or (0, 0)
        fills = pd.concat(list(rows)).sort_values(["time_ns", "event_id"], kind="stable").reset_index(drop=True)
        sums = fills["quantity"].fillna(0).astype("int64").cumsum()
        self.totals.update((int(trades + len(fills)), int(volume + sums.iloc[-1])))
        yield pd.DataFrame({"event_id": fills["event_id"], "symbol": fills["symbol"].astype("Int64"), "total_trades": trades + 1 + fills.index, "total_volume": volume + sums})

    def close(self) -> None:
        pass


def stream_running_totals(fills: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Trades and volume of a symbol after each fill, for update mode: a batch gives out its own fills only.

    The totals live in the state store (RocksDB, which the session must name), one row for each
    symbol; with ``idle_ms`` they expire when a symbol had no fill for so long. Fills of a batch
    count in order of their time, batches in order of arrival. Fills without a symbol count together.
    """
    keyed = fills.withColumn("_key", F.to_json(F.struct("symbol")))  # never null: pandas doesn't group nulls
    return keyed.groupBy("_key").transformWithStateInPandas(statefulProcessor=_Totals(idle_ms), outputStructType=TOTALS, outputMode="Update", timeMode="ProcessingTime" if idle_ms else "None")


def on_batch(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls a hook with each micro-batch of what is there now."""
    return stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name where all executors can write: below spark.checkpoint.dir.

    Only a session on one machine may go without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def incremental_ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, fmt: str = "json") -> None:
    """Appends the files that earlier runs haven't seen to a table, and waits for the end."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def grouped_apply(df: DataFrame, keys: Iterable[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A row-wise or group-wise Python function over groups: the escape hatch of last resort."""
    return df.groupBy(*keys).applyInPandas(fn, schema)
