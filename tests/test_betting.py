"""Resampling, two odds and the start of a path, against plain numpy."""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchgrid.operators import evaluation as E
from matchgrid.operators import windows as W
from matchgrid.plans import evaluation_queries


def test_bootstrap_against_plain_resampling(spark):
    rng = np.random.default_rng(1)
    returns = {g: np.round(rng.normal(0.01, 0.08, n), 2) for g, n in (("a", 60), ("b", 25))}
    rows = [(g, i, 0.1, float(r)) for g, x in returns.items() for i, r in enumerate(x)]
    bets = spark.createDataFrame([*rows, ("a", 99, 0.0, 0.0)], "g string, i int, stake double, bet_return double")
    got = {r["g"]: r for r in E.bootstrap(bets, ["g"], trials=10_000).collect()}
    again = {r["g"]: r for r in E.bootstrap(bets.repartition(7), ["g"], trials=10_000).collect()}
    for g, x in returns.items():
        assert tuple(got[g]) == tuple(again[g])
        finals = 1000 * np.prod(1 + x[rng.integers(0, len(x), (20_000, len(x)))], axis=1)
        for name, q in (("p05", 5), ("median", 50), ("p95", 95)):
            assert got[g][name] == pytest.approx(np.percentile(finals, q), rel=0.05)
        assert got[g]["p_profit"] == pytest.approx((finals > 1000).mean(), abs=0.03)


def test_bootstrap_of_one_return_and_of_no_bets(spark):
    schema = "g string, stake double, bet_return double"
    one = spark.createDataFrame([("a", 0.1, 0.5)] * 3, schema)
    r = E.bootstrap(one, ["g"], trials=100).first()
    assert (r["median"], r["p05"], r["p_profit"]) == (pytest.approx(3375.0), pytest.approx(3375.0), 1.0)
    lost = spark.createDataFrame([("a", 1.0, -1.0)], schema)
    assert E.bootstrap(lost, ["g"], trials=10).first()["median"] == 0.0
    assert E.bootstrap(one.filter("stake > 1"), ["g"], trials=10).count() == 0


def test_each_side_has_its_own_odds(spark):
    df = spark.createDataFrame([(0.6, 3), (0.4, 3), (0.5, 2)], "p_over double, total int")
    got = [(r["side"], r["won"], round(r["stake"], 6), round(r["bet_return"], 6)) for r in E.place_bets(df, over_odds=2.0, under_odds=3.0, kelly_fraction=1.0, cap=1.0).collect()]
    # edges: over 0.1 and under 0.0667; over below 0 and under 0.2667; over 0 and under 0.1667
    assert got == [("over", True, 0.2, 0.2), ("under", False, 0.4, -0.4), ("under", True, 0.25, 0.5)]


def test_a_path_begins_at_its_start(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, -0.5), ("b", 1, 0.1)], "s string, i int, bet_return double")
    path = E.with_start(E.bankroll_path(df, ["s"], ["i"]), ["s"])
    assert [(r["s"], r["i"], round(r["bankroll"], 6)) for r in path.orderBy("s", "i").collect()] == [("a", None, 1000.0), ("a", 1, 1500.0), ("a", 2, 750.0), ("b", None, 1000.0), ("b", 1, 1100.0)]


def test_bootstrap_in_chunks_is_the_bootstrap_in_one(spark):
    """Returns dealt to many chunks give the same distribution; exact moments are known."""
    rng = np.random.default_rng(1)
    returns = np.round(rng.normal(0.002, 0.05, 300), 4)
    rows = [("g", float(r), 0.1) for r in returns] + [("one", 0.1, 0.1)] * 4 + [(None, -1.0, 0.1)] * 3
    bets = spark.createDataFrame([*rows, ("g", 9.0, 0.0)], "team string, bet_return double, stake double")
    want = 1000 * np.exp(np.log1p(rng.choice(returns, (20_000, len(returns)))).sum(1))
    for chunk in (1, 20, 4096):
        got = {r["team"]: r for r in E.bootstrap(bets, ["team"], 4000, chunk=chunk).collect()}
        for q, name in ((0.5, "median"), (0.05, "p05"), (0.95, "p95")):
            assert got["g"][name] == pytest.approx(np.quantile(want, q), rel=0.08)
        assert got["g"]["p_profit"] == pytest.approx((want > 1000).mean(), abs=0.04)
        assert got["one"]["median"] == pytest.approx(1000 * 1.1**4) and got[None]["p95"] == 0.0 and got[None]["p_profit"] == 0.0
    a, b = (E.bootstrap(bets.repartition(n), ["team"], 700, chunk=7).collect() for n in (1, 5))
    assert sorted(map(str, a)) == sorted(map(str, b))  # reruns agree


def test_draws_of_all_chunks_add_up():
    bounds = np.concatenate([[0], np.cumsum([5, 1, 30, 4, 10, 50, 7])])
    parts = [E._draws_of([42, 7, 0], 3000, i, bounds) for i in range(7)]
    assert (sum(parts) == 107).all()
    for p, share in zip(parts, np.diff(bounds) / 107, strict=True):
        assert p.mean() == pytest.approx(107 * share, abs=5 * math.sqrt(107 * share / 3000) + 1e-9)
        assert p.var() == pytest.approx(107 * share * (1 - share), rel=0.15)


@pytest.mark.parametrize("rows", [1_000_000, 700])
def test_paths_of_thousands_of_bets_stay_exact(spark, rows):
    """Products beyond doubles, against decimals; whole and in ranges; the same in any grouping."""
    returns = ([0.045, -0.2, 0.045, -0.1, -0.2] * 1800)
    df = spark.createDataFrame([("a", i, r, 0.1, r > 0) for i, r in enumerate(returns)] + [("gone", 0, 0.1, 0.1, True), ("gone", 1, -1.0, 0.1, False), ("gone", 2, 0.5, 0.1, True)], "s string, i int, bet_return double, stake double, won boolean")
    path = E.bankroll_path(df, ["s"], ["i"], rows=rows)
    shown = {(r["s"], r["i"]): (r["text"], r["drawdown"]) for r in path.withColumn("text", evaluation_queries.log_sci(F.col("log_units"))).collect()}
    value = peak = Decimal(1000)
    with localcontext() as context:
        context.prec = 60
        for i, r in enumerate(returns):
            value *= 1 + Decimal(str(r))
            peak = max(peak, value)
            text, fall = shown["a", i]
            assert abs(Decimal(text) / value - 1) < Decimal("1e-6") and abs(fall - float(value / peak - 1)) < 1e-9
    assert value < Decimal("1e-330")  # a double holds none of it
    assert shown["gone", 1] == ("0.000000e+00", -1.0) == shown["gone", 2] and shown["gone", 0][0] == "1.100000e+03"
    log = W.running_log_product(df, ["s"], ["i"], F.lit(1.0) + F.col("bet_return"), "u", 1000.0, rows=rows)
    assert log.join(path.select("s", "i", "log_units"), ["s", "i"]).filter("u <> log_units").count() == 0
    got = E.backtest_summary(path, ["s"], ["i"]).filter("s = 'a'").withColumn("text", evaluation_queries.log_sci(F.col("final_log_units"))).first()
    assert got["text"] == shown["a", len(returns) - 1][0]
