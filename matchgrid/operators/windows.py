"""Window operators, orderings and top-n. Those over the rows of a key take keys of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.operators.ranges import LOG_UNITS, ROWS, log_units, rolling, running


def keep_first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key, the first of a total order. Row limits reach below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def keep_preferred(df: DataFrame, keys: Sequence[str], preferred: str = "career", source: str = "source", ties: Sequence[str] = ()) -> DataFrame:
    """One row for each key, of the preferred source if there is one."""
    return keep_first_by(df, keys, (F.col(source) != preferred).asc(), *[F.col(t).asc() for t in ties])


def keep_newest(df: DataFrame, keys: Sequence[str], batch: str, ties: Sequence[str] = ()) -> DataFrame:
    return keep_first_by(df, keys, F.col(batch).desc(), *[F.col(t).desc() for t in ties])


def strength_rank(strength: DataFrame) -> DataFrame:
    """Score and place of each team; nulls count as 0, an unknown squad size as 1."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = z("avg_rating") * F.lit(0.4) + z("avg_experience") * F.lit(0.3) + F.try_divide(z("total_goals"), F.coalesce(F.col("squad_size"), F.lit(1)).cast("double")) * F.lit(0.3)
    return strength.withColumn("strength", score).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("strength"), F.asc("team_id"))))


def running_product(df: DataFrame, keys: Sequence[str], order: Sequence[str], factor: Column, name: str, start: float, rows: int = ROWS) -> DataFrame:
    """start times the product of the factors so far, within each key."""
    return running(df, keys, order, {name: ("product", factor)}, rows).withColumn(name, F.lit(start) * F.col(name))


def running_log_product(df: DataFrame, keys: Sequence[str], order: Sequence[str], factor: Column, name: str, start: float, rows: int = ROWS) -> DataFrame:
    """log10 of ``running_product`` in whole units (ranges.LOG_UNITS): exact in any order, for products of any size."""
    first = F.lit(round(math.log10(start) * LOG_UNITS)).cast("decimal(28,0)")
    return running(df, keys, order, {name: ("sum", log_units(factor))}, rows).withColumn(name, first + F.col(name))


def drawdown(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, start: float, rows: int = ROWS) -> DataFrame:
    """running_peak (not below the start) and drawdown, 0 or less."""
    df = running(df, keys, order, {"running_peak": ("max", F.col(value))}, rows).withColumn("running_peak", F.greatest("running_peak", F.lit(start)))
    return df.withColumn("drawdown", (F.col(value) - F.col("running_peak")) / F.col("running_peak"))


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def rolling_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int, name: str, rows: int = ROWS) -> DataFrame:
    """Mean of the last n rows; nulls are skipped, short starts allowed."""
    return rolling(df, keys, order, n, lambda w: {name: F.avg(value).over(w.rowsBetween(1 - n, 0))}, rows)


def rolling_flow_imbalance(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, history: int = 100, rows: int = ROWS) -> DataFrame:
    """(bought - sold) / (bought + sold) over the last n fills (at most ``history``); null on 0."""
    n = min(n, history)

    def imbalance(w) -> dict[str, Column]:
        buy, sell = (F.sum(F.when(F.col("taker_side") == side, F.col("quantity")).otherwise(0)).over(w.rowsBetween(1 - n, 0)) for side in ("BUY", "SELL"))
        return {"flow_imbalance": F.try_divide((buy - sell).cast("double"), (buy + sell).cast("double"))}

    return rolling(df, keys, order, n, imbalance, rows)


def every_nth(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, rows: int = ROWS) -> DataFrame:
    """Rows whose number within their key (``nth``, from 1) is divisible by n."""
    return running(df, keys, order, {"nth": ("sum", F.lit(1))}, rows).filter(F.col("nth") % n == 0)


def cumulative_counters(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = ROWS) -> DataFrame:
    return running(df, keys, order, {"total_trades": ("sum", F.lit(1)), "total_volume": ("sum", F.col("quantity"))}, rows)


def top_n(df: DataFrame, n: int, value: str, ties: str) -> DataFrame:
    """The n greatest, nulls never before numbers, ties to the smaller id: no full sort."""
    return df.orderBy(F.col(value).desc_nulls_last(), F.col(ties).asc()).limit(n)


def depth(levels: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The n best price levels of each side: highest bids, lowest asks."""
    best = F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy(*keys, "side").orderBy(best)
    return levels.withColumn("level", F.row_number().over(w)).filter(F.col("level") <= n)
