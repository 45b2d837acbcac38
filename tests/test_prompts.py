"""Steps that the prompt queries share: what is rounded, dealt, added up and rendered."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from matchgrid.functions import scalars as S
from matchgrid.operators import aggregates as A
from matchgrid.operators import text as G
from matchgrid.plans import catalog

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_sums_are_rounded_as_by_way_of_decimals(spark):
    x = spark.range(40000).select(F.explode(F.array((F.col("id") - 20000) / 200.0, F.col("id") / 7.0, F.col("id") / 3.0 * 1e6, F.col("id") / 40.0 + 1e-10, F.col("id") / 8.0 * 1e12)).alias("x"))
    x = x.union(spark.createDataFrame([(float("nan"),), (float("inf"),), (-0.0,), (None,)], "x double"))
    for digits in (0, 1, 2):
        assert x.filter(~S.half_even_of_sum(F.col("x"), digits).eqNullSafe(S.half_even(F.round("x", 9), digits))).count() == 0
    for digits in (1, 2, 3):
        assert x.filter(~S.fixed_places(F.col("x"), digits).eqNullSafe(F.format_string(f"%.{digits}f", S.half_even(F.col("x"), digits)))).count() == 0


def test_player_seasons_are_hashed_and_right(spark):
    raw = spark.createDataFrame([(1, 1990, "a", 1.0, 2.0), (1, 1990, "b", 2.0, None), (1, 1990, None, None, 5.0), (1, 1991, None, None, None), (2, 1990, "c", 4.0, 1.0)], "player_id long, season int, position string, goals double, rating double")
    out = A.player_seasons(raw, ["goals"], ["rating"])
    assert {tuple(r) for r in out.collect()} == {(1, 1990, "b", 3.0, 3.5), (1, 1991, None, None, None), (2, 1990, "c", 4.0, 1.0)}


@given
def test_raw_rows_are_hashed_and_lineups_dealt_once(spark):
    plan = catalog.QUERIES["g05_reasoning"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "Exchange" in x]
    assert not any("l_suppkey" in x and "l_orderkey" in x for x in shuffles)  # no other shuffle for the players of an order
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "l_shipdate" in x)
    above = [x for x in lines[:scan] if "Aggregate" in x][-1]
    assert "HashAggregate" in above and "SortAggregate" not in above


@given
@pytest.mark.parametrize("name", ["g01_match_context", "g05_reasoning"])
def test_starters_carry_what_is_shown(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "cards_red" not in plan and "tackles" not in plan


def test_lowest_of_small_and_large_numbers(spark):
    def coach(*rows):
        columns = "fixture_id long, team_id long, player_id long, number long, position string, coach string, formation string, goals double, rating double, seasons_with_data long, form_position string"
        made = spark.createDataFrame([(1, 1, player, number, "Winger", name, "f", 1.0, 1.0, 1, None) for name, number, player in rows], columns)
        return G.team_parts(made).select(G.team_block(F.col("parts"), F.lit(1), made.columns).alias("b")).first()["b"]["coach"]

    assert coach(("a", 2, 5), ("b", 1, 2**50), ("c", 1, 2**50 + 1)) == "b"
    assert coach(("a", 1, 7), ("b", 1, 2**50)) == "a"
    assert coach(("a", -3, 7), ("b", -3, 6), ("c", 2**40, 1)) == "b"
    assert coach(("a", 0, 0), ("b", None, 9), ("c", -(2**30), 1)) == "b"


def test_reasons_are_the_first_three(spark):
    def profile(goals, rating, top, passing):
        return F.struct(*[F.lit(float(x)).alias(n) for x, n in ((goals, "team_total_goals"), (rating, "team_avg_rating"), (top, "top_scorer"), (passing, "team_avg_passes_accuracy"))])

    def reasons(home, away):
        row = spark.range(1).select(F.lit("H").alias("home_team_name"), F.lit("A").alias("away_team_name"), F.lit("draw").alias("result"), profile(*home).alias("home_profile"), profile(*away).alias("away_profile"))
        return row.select(G.render_reasoning(F.lit(False)).alias("r")).first()["r"]

    assert reasons((9, 7, 9, 90), (1, 6, 1, 50)) == "H's squad has higher goal output (9 vs 1). H has a higher average rating (7.0 vs 6.0). H's top scorer is more prolific (9 vs 1 goals)."
    assert reasons((9, 6, 9, 50), (1, 6, 1, 90)) == "H's squad has higher goal output (9 vs 1). H's top scorer is more prolific (9 vs 1 goals). A has better passing (90% vs 50%)."
    assert reasons((1, 6, 1, 90), (1, 6, 1, 90)) == "Both teams have closely matched statistical profiles suggesting an even contest."
