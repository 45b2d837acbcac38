"""Scores of predictions, calibration, paired tests and betting replays, grouped on the cluster."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.functions.scalars import kelly, p_over, wilson
from matchgrid.operators.projections import derive_prediction_flags
from matchgrid.operators.ranges import LOG_UNITS, ROWS, RUIN, from_log_units, log_compound

# -- scores ------------------------------------------------------------------------------------


def goal_mae() -> Column:
    """Mean of the two absolute goal errors of each row, averaged."""
    return F.avg((F.abs(F.col("pred_home") - F.col("gt_home")) + F.abs(F.col("pred_away") - F.col("gt_away"))) / 2.0)


def share(flag: str) -> Column:
    return F.avg(F.col(flag).cast("int"))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y.cast("double"), F.lit(2.0)))


def bin_of(p: Column, bins: int) -> Column:
    """Number of the bin [i/bins, (i+1)/bins), the last one closed; null outside [0, 1].

    The edges are i * (1 / bins) as doubles, so that .3 is in the third of ten bins.
    """
    width, out = 1.0 / bins, None
    for i in range(bins):
        low, high = i * width, 1.0 if i == bins - 1 else (i + 1) * width
        inside = (p >= low) & ((p <= high) if i == bins - 1 else (p < high))
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def ece(df: DataFrame, keys: Sequence[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """Expected calibration error of each group: bin shares times |frequency - mean p|.

    A p outside [0, 1] has no bin but counts in the size.
    """
    rows = df.groupBy(*keys, bin_of(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc"))
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)
    return rows.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, keys: Sequence[str], p: str, y: str, bins: int = 5) -> DataFrame:
    """Mean p, frequency and size of each bin that isn't empty."""
    rows = df.withColumn("bin", bin_of(F.col(p), bins)).groupBy(*keys, "bin")
    out = rows.agg(F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("frequency"), F.count("bin").alias("n"))
    # rows without a bin go by its count: a filter on the bin sinks below all joins and repeats there what p is made of
    return out.filter("n > 0")


def regime_summary(flags: DataFrame, keys: Sequence[str] = ("regime",)) -> DataFrame:
    """n, accuracies, goal error, Brier score and calibration error of each regime."""
    df = flags.withColumn("p_over", p_over(F.col("pred_total").cast("double")))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        share("correct_result").alias("result_accuracy"),
        share("correct_score").alias("exact_score"),
        goal_mae().alias("goal_mae"),
        share("correct_direction").alias("ou_accuracy"),
        brier(F.col("p_over"), F.col("gt_over")).alias("brier"),
    )
    return out.join(ece(df, keys, "p_over", "gt_over"), list(keys))


def wilson_table(flags: DataFrame, keys: Sequence[str] = ("regime",), flag: str = "correct_result") -> DataFrame:
    """Accuracy with its interval over all rows and over the named ones."""
    subset = F.explode(F.when(F.col("anonymized"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("named"))))
    out = flags.withColumn("subset", subset).groupBy(*keys, "subset").agg(F.count_if(flag).alias("hits"), F.count("*").alias("n"))
    return out.withColumn("w", wilson(F.col("hits"), F.col("n"))).select(*keys, "subset", "hits", "n", "w.*")


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts: min(1, 2 P(X <= min(b, c)), X ~ Bin(b + c, 1/2)); 1 if none.

    Terms are added as exp of logarithms, so that large counts don't underflow.
    """
    n, k = b + c, F.least(b, c)

    def step(state: Column, i: Column) -> Column:
        term = state["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(term.alias("t"), (state["s"] + F.exp(term)).alias("s"))

    first = -n.cast("double") * F.lit(math.log(2.0))
    start = F.struct(first.alias("t"), F.exp(first).alias("s"))
    tail = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, step, lambda s: s["s"])).otherwise(F.exp(first))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * tail))


def contingency(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    x, y = F.col(a), F.col(b)
    return pairs.groupBy(*keys).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"), F.count_if(~x & ~y).alias("neither"))


METRICS = {"result": "correct_result", "score": "correct_score", "over_under": "correct_direction"}


def regime_pairs(flags: DataFrame, keys: Sequence[str] = ("fixture_id", "anonymized")) -> DataFrame:
    """Each row of one regime beside the same row of a later-named one, in long form by metric."""
    long = flags.select("regime", *keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(x).alias("hit")) for m, x in METRICS.items()])).alias("_pick"))
    long = long.select("regime", *keys, F.col("_pick")["metric"].alias("metric"), F.col("_pick")["hit"].alias("hit"))
    a = long.withColumnsRenamed({"regime": "regime_a", "hit": "hit_a"})
    b = long.withColumnsRenamed({"regime": "regime_b", "hit": "hit_b"})
    return a.join(b, [*keys, "metric"]).filter("regime_a < regime_b")


def mcnemar_table(flags: DataFrame) -> DataFrame:
    """Discordant counts and exact p of all pairs of regimes and metrics."""
    out = contingency(regime_pairs(flags), ["regime_a", "regime_b", "metric"], "hit_a", "hit_b")
    return out.withColumn("p_value", mcnemar_p(F.col("a_only"), F.col("b_only")))


def model_comparison(llm: DataFrame, tabular: DataFrame, keys: Sequence[str] = ("fixture_id", "regime")) -> DataFrame:
    """The scores of both models by regime, on the matches that both have rows of.

    The language model is right where its score gives the result; the tabular one where its label is
    the stored one. Both tables: keys, gt_home, gt_away, gt_result, pred_result, pred_home, pred_away.
    """
    names = [*keys, "gt_home", "gt_away", "gt_result", "pred_result", "pred_home", "pred_away"]
    a = derive_prediction_flags(llm.select(*names)).withColumn("model", F.lit("llm"))
    b = derive_prediction_flags(tabular.select(*names)).withColumn("correct_result", F.col("pred_result") == F.col("gt_result")).withColumn("model", F.lit("tabular"))
    shared = a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys))
    both = a.unionByName(b).join(shared, list(keys), "left_semi")
    measures = {"accuracy": share("correct_result"), "exact_score": share("correct_score"), "goal_mae": goal_mae(), "ou_accuracy": share("correct_direction")}
    return both.groupBy("model", "regime").agg(F.count("*").alias("n"), *[x.alias(name) for name, x in measures.items()])


def baseline(df: DataFrame, strategy: str, seed: int = 42) -> DataFrame:
    """Fixed predictions: home (1-0), draw (1-1), or random by .40 / .35 / .25 through a hash of the key."""
    if strategy in ("home", "draw"):
        return df.withColumns({"pred_home": F.lit(1).cast("long"), "pred_away": F.lit(int(strategy == "draw")).cast("long")})
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("fixture_id").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return df.withColumns({"pred_home": F.when(u < 0.75, 1).otherwise(0).cast("long"), "pred_away": F.when(u < 0.4, 0).otherwise(1).cast("long")})


# -- betting -----------------------------------------------------------------------------------


def place_bets(
    df: DataFrame,
    over_odds: float = 1.9,
    under_odds: float = 1.9,
    kelly_fraction: Column | float = 0.25,
    cap: Column | float = 0.1,
    edge: float = 0.05,
    line: float = 2.5,
) -> DataFrame:
    """side, stake (a share of the bankroll, 0 if skipped) and bet_return of each row.

    The side with the larger edge over its own odds is backed, over on a tie; none below the edge
    threshold. Needs p_over and total.
    """
    part = kelly_fraction if isinstance(kelly_fraction, Column) else F.lit(float(kelly_fraction))
    most = cap if isinstance(cap, Column) else F.lit(float(cap))
    p = F.col("p_over")
    over, under = p - F.lit(1.0 / over_odds), (F.lit(1.0) - p) - F.lit(1.0 / under_odds)
    backs_over = over >= under
    chance = F.when(backs_over, p).otherwise(F.lit(1.0) - p)
    odds = F.when(backs_over, F.lit(over_odds)).otherwise(F.lit(under_odds))
    stake = F.least(part * kelly(chance, odds), most)
    placed = (F.greatest(over, under) >= edge) & (stake > 0)
    won = backs_over == (F.col("total") > line)
    gain = F.when(backs_over, F.lit(over_odds - 1.0)).otherwise(F.lit(under_odds - 1.0))
    df = df.withColumns({"side": F.when(placed, F.when(backs_over, "over").otherwise("under")), "stake": F.when(placed, stake).otherwise(0.0)})
    return df.withColumns({"won": F.when(placed, won), "bet_return": F.when(placed, F.when(won, F.col("stake") * gain).otherwise(-F.col("stake"))).otherwise(0.0)})


def bankroll_path(bets: DataFrame, keys: Sequence[str], order: Sequence[str], start: float = 1000.0, rows: int = ROWS) -> DataFrame:
    """Bankroll after each step, its peak so far (not below the start) and the drawdown.

    Stakes are shares, so a path is a running product. It is kept as a sum of logarithms in whole
    units (log_units: log10 of the bankroll, of which a double may hold no more than 0), so neither the
    order of multiplication nor the length of a path shows; a return of -1 or less ends it at 0. The
    path of a strategy of many bets is made in ranges of its order, which join by their sums and peaks.
    """
    df = log_compound(bets, keys, order, F.lit(1.0) + F.col("bet_return"), "log_units", "_peak", rows)
    value = lambda c: F.when(F.col(c) > RUIN / 2, F.lit(start) * from_log_units(F.col(c))).otherwise(0.0)
    out = df.withColumns({"bankroll": value("log_units"), "peak": value("_peak"), "drawdown": F.when(F.col("log_units") > RUIN / 2, from_log_units(F.col("log_units") - F.col("_peak")) - F.lit(1.0)).otherwise(-1.0)})
    return out.withColumn("log_units", _from(start) + F.col("log_units")).drop("_peak")


def _from(start: float) -> Column:
    return F.lit(round(math.log10(start) * LOG_UNITS)).cast("decimal(28,0)")


def with_start(path: DataFrame, keys: Sequence[str], start: float = 1000.0) -> DataFrame:
    """A path with the point that it starts from: one more row for each key, before any bet, whose
    other columns are null."""
    first = path.select(*keys).distinct().select(*keys, _from(start).cast(path.schema["log_units"].dataType).alias("log_units"), F.lit(start).alias("bankroll"), F.lit(start).alias("peak"), F.lit(0.0).alias("drawdown"))
    return path.unionByName(first, allowMissingColumns=True)


def backtest_summary(path: DataFrame, keys: Sequence[str], order: Sequence[str], start: float = 1000.0) -> DataFrame:
    placed = F.col("stake") > 0
    returns = F.when(placed, F.col("bet_return"))
    out = path.groupBy(*keys).agg(
        F.max_by("bankroll", F.struct(*order)).alias("final"),
        F.max_by("log_units", F.struct(*order)).alias("final_log_units"),
        F.coalesce(F.avg(F.when(placed, F.col("won").cast("int"))), F.lit(0.0)).alias("win_rate"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.coalesce(F.try_divide(F.avg(returns), F.nullif(F.stddev_samp(returns), F.lit(0.0))), F.lit(0.0)).alias("sharpe"),
        F.count_if(placed).alias("bets"),
        F.count_if(~placed).alias("skipped"),
    )
    return out.withColumns({"roi": F.col("final") / F.lit(start) - F.lit(1.0), "sharpe_scaled": F.col("sharpe") * F.sqrt(F.col("bets").cast("double"))})


#: Different returns of a group that are drawn together, where it has no more than CHUNK squared.
CHUNK = 4096


def bootstrap(bets: DataFrame, keys: Sequence[str], trials: int = 10_000, seed: int = 42, start: float = 1000.0, block: int = 500, chunk: int = CHUNK) -> DataFrame:
    """Quantiles of the final bankroll when a group's placed bets are drawn anew with replacement.

    As many bets as a group has are drawn in each trial, and their order doesn't matter: how often
    each different return is drawn is one multinomial draw. So a group is first counted by return,
    and a trial costs as much as it has different returns, however many bets there are. Returns are
    dealt to chunks by a hash. How many of a trial's draws fall in a chunk follows from binomial
    draws down a binary tree over the chunks, which every chunk of the group repeats alike for its
    own path; then a chunk draws its own returns, and its part of the trial's log gain is added to
    the others'. A task holds one chunk and one block of trials; a group's values are one for each
    trial. Generators are seeded by group, block and place in the tree: reruns agree.
    """
    # counted first and filtered then: a filter below would repeat all of what a stake is made of
    counted = bets.groupBy(*keys, "bet_return").agg(F.count_if(F.col("stake") > 0).alias("_n")).filter("_n > 0")
    group = F.xxhash64(*[F.col(k) for k in keys]) if keys else F.lit(0).cast("long")
    sizes = counted.groupBy(*keys).agg(F.count("*").alias("_d")).select(group.alias("_of"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.ceil(F.col("_d") / F.greatest(F.lit(float(chunk)), F.sqrt("_d"))).alias("_chunks"))
    alike = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] or [F.lit(True)]
    dealt = counted.join(sizes, alike).withColumn("_chunk", F.pmod(F.xxhash64("bet_return"), F.col("_chunks")).cast("int"))
    chunks = dealt.groupBy("_of", *keys, "_chunk").agg(F.array_sort(F.collect_list(F.struct("bet_return", "_n"))).alias("_r"), F.sum("_n").alias("_size"))
    weights = chunks.groupBy("_of", *keys).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_size"))).alias("_w"))
    weights = weights.select("_w", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    blocks = -(-trials // block)
    tasks = chunks.join(weights, alike).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition("_of", "_chunk", "_block")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def gains(of: pd.Series, chunk: pd.Series, b: pd.Series, returns: pd.Series, counts: pd.Series, chunks: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for g, c, i, r, n, ids, w in zip(of, chunk, b, returns, counts, chunks, sizes, strict=True):
            name = [seed, g & (1 << 64) - 1, i]
            drawn = _draws_of(name, min(block, trials - i * block), int(np.searchsorted(ids, c)), np.concatenate([[0], np.cumsum(w)]))
            out.append(_log_gains(np.random.default_rng([*name, 1, c]), drawn, r, n))
        return pd.Series(out, dtype=object)

    parts = tasks.select(*keys, "_block", F.posexplode(gains("_of", "_chunk", "_block", "_r.bet_return", "_r._n", "_w._chunk", "_w._size")).alias("_trial", "_gain"))
    finals = parts.groupBy(*keys, "_block", "_trial").agg((F.lit(start) * F.exp(F.round(F.sum("_gain"), 9))).alias("final"))
    out = finals.groupBy(*keys).agg(F.percentile("final", F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95))).alias("q"), F.avg((F.col("final") > start).cast("int")).alias("p_profit"))
    return out.select(*keys, F.col("q")[0].alias("median"), F.col("q")[1].alias("p05"), F.col("q")[2].alias("p95"), "p_profit")


def _draws_of(name: list[int], size: int, at: int, bounds: np.ndarray) -> np.ndarray:
    """How many of each trial's draws fall in the chunk number ``at``. ``bounds``: sums of the chunks' sizes before each."""
    low, high, node = 0, len(bounds) - 1, 1
    drawn = np.full(size, bounds[-1], np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng([*name, 0, node]).binomial(drawn, (bounds[middle] - bounds[low]) / (bounds[high] - bounds[low]))
        if at < middle:
            high, drawn, node = middle, left, 2 * node
        else:
            low, drawn, node = middle, drawn - left, 2 * node + 1
    return drawn


def _log_gains(rng: np.random.Generator, drawn: np.ndarray, returns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the log gains of each trial's draws; a total loss that isn't drawn costs nothing."""
    times = rng.multinomial(drawn, counts / counts.sum())
    alive = returns > -1.0
    out = times[:, alive] @ np.log1p(returns[alive])
    out[times[:, ~alive].any(1)] = -np.inf
    return out
