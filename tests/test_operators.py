"""Edge cases of the relational operators on literal frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from matchgrid.operators import aggregates as A
from matchgrid.operators import checks as Q
from matchgrid.operators import evaluation as E
from matchgrid.operators import joins as J
from matchgrid.operators import orders as L
from matchgrid.operators import projections as P
from matchgrid.operators import text as G
from matchgrid.operators import windows as W


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_sums_keep_or_drop_null(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "k int, x double")
    assert rows(df.groupBy("k").agg(A.sum_or_null("x"), A.sum_or_zero("x"))) == [(1, None, 0.0)]


def test_player_seasons_leave_out_null_keys(spark):
    df = spark.createDataFrame([(None, 2000, 1.0, 2.0), (1, 2000, 1.0, None), (1, 2000, 2.0, 4.0)], "player_id long, season int, goals double, rating double")
    assert rows(A.aggregate_player_seasons(df, ["goals"], ["rating"])) == [(1, 2000, 3.0, 4.0)]


def test_pairing_raises(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "k int, x int")
    b = spark.createDataFrame([(1, 2)], "k int, x int")
    with pytest.raises(ValueError, match="duplicate"):
        J.pair_on_match(a, b, ["k"])
    with pytest.raises(ValueError, match="partner"):
        J.pair_on_match(b, spark.createDataFrame([(2, 2)], "k int, x int"), ["k"])


def test_rates_on_zero_denominators(spark):
    names = "minutes goals assists shots_on_target shots_total duels_won duels_total tackles_total dribbles_success dribbles_attempts".split()
    df = spark.createDataFrame([tuple([0.0] * len(names))], ", ".join(f"{n} double" for n in names))
    assert P.derive_player_rates(df).first()["goals_per_90"] is None


def test_event_buckets(spark):
    df = spark.createDataFrame([(-2, None), (0, 1), (15, None), (16, 0), (90, None), (105, None), (121, None)], "time_elapsed long, time_extra long")
    assert [r["time_bucket"] for r in P.derive_event_features(df).collect()] == ["0-15", "0-15", "0-15", "16-30", "76-90", "91-105", "106-120"]


def test_no_bets(spark):
    df = spark.createDataFrame([("a", 1, 0.56, 2), ("a", 2, 0.5, 3)], "s string, i int, p_over double, total int")
    path = E.bankroll_path(E.place_bets(df), ["s"], ["i"])
    got = E.backtest_summary(path, ["s"], ["i"]).first()
    assert (got["final"], got["win_rate"], got["max_drawdown"], got["sharpe"], got["bets"], got["skipped"]) == (1000.0, 0.0, 0.0, 0.0, 0, 2)


def test_stake_is_capped(spark):
    df = spark.createDataFrame([(0.99, 4)], "p_over double, total int")
    got = E.place_bets(df).first()
    assert got["stake"] == pytest.approx(0.1)
    assert got["bet_return"] == pytest.approx(0.09)


def test_book_with_one_side(spark):
    l2 = spark.createDataFrame([(1, "BUY", 10.0, 5, 1), (1, "BUY", 9.0, 7, 1)], "symbol int, side string, price double, quantity long, orders long")
    got = L.top_of_book(l2).first()
    assert (got["bid"], got["bid_qty"], got["ask"], got["spread"], got["micro_price"]) == (10.0, 5, None, None, None)
    assert L.market_metrics(l2).first()["order_imbalance"] == 1.0


def test_keep_preferred_breaks_ties(spark):
    df = spark.createDataFrame([(1, "current", 1), (1, "career", 3), (1, "career", 2)], "k int, source string, n int")
    assert rows(W.keep_preferred(df, ["k"], ties=["n"])) == [(1, "career", 2)]


def test_form_of_short_histories(spark):
    tm = spark.createDataFrame([("a", 1990, 1, 1, 0), ("a", 1994, 2, 0, 0), ("a", 1994, 3, 0, 2), ("a", 1998, 4, 1, 1)], "team_name string, season int, fixture_id int, scored int, conceded int")
    got = {r["season"]: r["form"] for r in G.form_before(tm).collect()}
    assert got == {1990: "", 1994: "W 1-0", 1998: "W 1-0, D 0-0, L 0-2"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Prediction: home_win\nScore: 0-1\nReasoning: a\nb", ("away_win", 0, 1, "a\nb")),
        ("Prediction: Draw", ("draw", None, None, None)),
        ("Score: 2 – 2", ("draw", 2, 2, None)),
        ("nothing", (None, None, None, None)),
    ],
)
def test_parse(spark, text, want):
    got = G.parse_outputs(spark.createDataFrame([(text,)], "output string")).first()
    assert (got["prediction"], got["parsed_home"], got["parsed_away"], got["reasoning"]) == want


def test_checks_on_empty(spark):
    df = spark.createDataFrame([], "k int, x double")
    assert rows(Q.check_range(df, "x", 0, 1)) == [("range_x", True, "0")]
    assert rows(Q.check_duplicates(df, ["k"])) == [("duplicates", True, "0")]
    assert Q.check_coverage(df, df, "k", 90.0).first()["ok"] is False


def test_season_gap(spark):
    df = spark.createDataFrame([(1, s) for s in (2014, 2016, 2022)] + [(2, 2016)], "p int, s int")
    assert rows(Q.check_inner_gap(df, "p", "s", 2015, 2017)) == [(1, [2015, 2017])]


def test_append_all(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "y int")
    assert sorted(rows(J.append_all(a, b)), key=str) == [(1, None), (None, 2)]


def test_team_measures_count_second_yellows_twice(spark):
    schema = "match_id long, team string, possession_team string, possession long, type string, outcome string, subtype string, body_part string, height string, technique string, length double, is_cross boolean, card string, xg double"
    df = spark.createDataFrame([(1, "a", None, 1, "Bad Behaviour", None, None, None, None, None, None, None, "Second Yellow", 0.0), (1, "b", None, 1, "Shot", "Goal", None, None, None, None, None, None, None, 0.5)], schema)
    got = {r["team"]: r for r in A.team_match_stats(df).collect()}
    assert (got["a"]["yellow_cards"], got["a"]["red_cards"], got["a"]["xg_conceded"]) == (1, 1, 0.5)
    assert {r["ball_possession_pct"] for r in A.possession_share(df).collect()} == {50.0}
    assert df.filter(F.col("type") == "Shot").count() == 1


def test_one_drifted_file_among_many(spark, tmp_path):
    from pyspark.sql import types as T

    from matchgrid.operators import checks

    good = spark.range(40).selectExpr("id", "cast(id as string) as name", "cast(id as double) as x")
    good.repartition(12).write.parquet(str(tmp_path / "t"))
    good.selectExpr("id", "cast(x as int) as x", "name", "1 as more").coalesce(1).write.parquet(str(tmp_path / "t" / "late" / "day=1"))
    good.selectExpr("name", "id", "x").coalesce(1).write.parquet(str(tmp_path / "t" / "late" / "day=2"))
    want = T.StructType.fromDDL("id long, name string, x double")
    for through_spark in (False, True):
        found = checks.check_file_schemas(spark, [str(tmp_path / "t")], want, through_spark).collect()
        assert sorted((r["file"].split("/")[-2], r["column"], r["problem"]) for r in found if r["column"]) == [("day=1", "more", "extra"), ("day=1", "x", "type int for double")]
        assert [(r["file"].split("/")[-2], r["problem"]) for r in found if r["column"] is None] == [("day=2", "order")]
    assert checks.check_file_schemas(spark, [str(tmp_path / "t" / "late" / "day=2")], T.StructType.fromDDL("name string, id long, x double")).count() == 0


def test_sides_of_a_match_and_repeated_teams(spark):
    matches = spark.createDataFrame([(1, 10, 20), (2, 20, 30), (3, 30, None)], "fixture_id long, home_team_id long, away_team_id long")
    teams = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 30, "c"), (2, None, "d"), (9, 1, "e")], "fixture_id long, team_id long, x string")
    got = J.attach_sides(matches, teams).orderBy("fixture_id").collect()
    assert [(r["home_profile"] and r["home_profile"]["x"], r["away_profile"] and r["away_profile"]["x"]) for r in got] == [("a", "b"), (None, "c"), (None, None)]
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        J.attach_sides(matches, teams.union(teams.limit(1))).collect()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reliability_makes_p_once(spark):
    left, right = (spark.range(3).select(F.lit(1).alias("k"), F.col("id").alias(name)) for name in ("a", "b"))
    df = left.join(right, "k").select("k", F.exp(-(F.col("a") + F.col("b")).cast("double")).alias("p"), (F.col("a") > 0).alias("y"))
    df = df.unionByName(spark.sql("SELECT 1 AS k, 2.0D AS p, true AS y"))
    out = E.reliability(df, ["k"], "p", "y")
    assert optimized(out).count("EXP(") == 1  # a filter on the bin would sink into the join with one for each edge
    assert {(r["bin"], r["n"]) for r in out.collect()} == {(0, 6), (1, 2), (4, 1)}


def made_starters(spark):
    rows_ = [
        # fixture, team, player, number, position, coach, formation, goals, rating, seasons, form_position
        (1, 10, 1, 3, "Libero", "B", "4-4-2", 2.5, 7.0, 2, "Defender"),
        (1, 10, 2, 3, None, "A", None, 1.25, None, 1, "Libero"),
        (1, 10, 3, 1, "Winger", "C", "3-5-2", None, None, None, None),
        (1, 10, 4, 2, "Attacker", "C", "3-5-2", 9.0, 6.0, 1, None),
        (1, 10, 5, 7, None, "C", "3-5-2", 0.0, 8.0, 1, None),
        (1, 10, 6, 8, "", "C", "3-5-2", 4.0, None, 3, "Anchor"),
        (1, 11, 7, 5, "Goalkeeper", "D", "4-3-3", None, None, None, None),
        (2, 10, 8, 5, "Winger", "D", "4-3-3", 1.0, None, 1, None),
        (2, 10, 9, 5, "Goalkeeper", "D", "4-3-3", 3.0, 5.5, 1, None),
    ]
    return spark.createDataFrame(rows_, "fixture_id long, team_id long, player_id long, number long, position string, coach string, formation string, goals double, rating double, seasons_with_data long, form_position string")


def test_blocks_of_many_coaches_and_odd_positions(spark):
    starters = made_starters(spark)
    parts = G.team_parts(starters)
    got = {(r["fixture_id"], t): r[f"t{t}"] for r in parts.select("fixture_id", *[G.team_block(F.col("parts"), F.lit(t), starters.columns).alias(f"t{t}") for t in (10, 11, 12)]).collect() for t in (10, 11, 12)}
    assert {k for k, v in got.items() if v is not None} == {(1, 10), (2, 10)}
    one, two = got[1, 10], got[2, 10]
    assert (one["num_starters_with_data"], one["team_total_goals"], one["team_avg_rating"], one["top_scorer"]) == (5, 16.8, 7.0, 9.0)
    assert (one["coach"], one["formation"]) == ("C", "3-5-2")  # of the lowest number, with or without form
    assert one["positions"] == "1 ATT, 1 ANC, 2 LIB, 1 UNK"
    assert (two["positions"], two["coach"], two["team_avg_rating"]) == ("1 GOA, 1 WIN", "D", 5.5)
    profile = {(r["fixture_id"], r["team_id"]): r for r in A.team_profile(starters).collect()}
    assert all(profile[k][c] == got[k][c] for k in profile for c in profile[k].asDict() if c.startswith(("team_", "num_")) and c != "team_id")


def test_blocks_are_no_lists_of_starters(spark):
    parts = G.team_parts(made_starters(spark))
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # dealt once, by match
    of_one = parts.filter("fixture_id = 2").first()["parts"]
    assert len(of_one) == 1 and not any(isinstance(x, list) for x in of_one[0])


def test_chat_samples_are_in_order_without_a_sample(spark):
    m = spark.range(40).selectExpr("id AS fixture_id", "1990 AS season", "'A' AS home_team_name", "'B' AS away_team_name", "1L AS home_goals", "0L AS away_goals", "'home_win' AS result", "'' AS venue", "'r' AS round", "'' AS home_form", "'' AS away_form")
    profile = "named_struct('team_total_goals', 1.0D, 'team_avg_rating', 1.0D, 'top_scorer', 1.0D, 'team_avg_passes_accuracy', 1.0D)"
    m = m.selectExpr("*", f"{profile} AS home_profile", f"{profile} AS away_profile", "array('x', 'y') AS blocks", "named_struct('matches', 0L, 'team1_wins', 0L, 'team2_wins', 0L, 'draws', 0L) AS h2h")
    out = G.chat_samples(m)
    assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    keys = [r["shuffle_key"] for r in out.collect()]
    assert len(keys) == 80 and keys == sorted(keys)


def test_profiles_come_out_of_a_shuffle_as_they_went_in(spark):
    names = [name for word in G.PACKED for name, _, _ in word]
    most = {name: (2**bits - 2) / per for word in G.PACKED for name, per, bits in word}
    rows = [dict.fromkeys(names, 0.0), {n: None for n in names}, most, dict.fromkeys(names, 7.0), None]
    rows += [{**most, "team_avg_rating": 33.33, "team_total_goals": 0.1, "top_scorer": x} for x in (0.29, 41943.02, 1e15, -1.5, 0.123, float("inf"))]
    rows += [{**most, n: v} for n in names for v in (most[n] + 1, None)]
    full = [None if r is None else {**r, "num_starters_with_data": None if r["num_starters_with_data"] is None else int(r["num_starters_with_data"]), "coach": None if i % 3 else "C", "formation": "", "positions": "1 GOA"} for i, r in enumerate(rows)]
    schema = "id long, p struct<" + ", ".join(f"{n}: {'bigint' if n.startswith('num') else 'double'}" for n in names) + ", coach: string, formation: string, positions: string>"
    df = spark.createDataFrame(list(enumerate(full)), schema)
    out = df.select("id", "p", G.packed_profile(F.col("p")).alias("k")).withColumn("q", G.unpacked_profile(F.col("k"))).collect()
    assert len(out) == len(full)
    for r in out:
        assert (r["p"] is None) == (r["q"] is None)
        if r["p"] is not None:
            assert {n: r["q"][n] for n in r["p"].asDict()} == r["p"].asDict()
    wide = {r["id"] for r in out if r["k"] is not None and r["k"]["wide"] is not None}
    assert not {0, 1, 2, 3, 5, 6} & wide and {7, 8, 9, 10} <= wide


def test_chat_samples_carry_no_text_of_a_block_through_their_shuffle(spark):
    from matchgrid.plans import text_queries
    from matchgrid.plans.views import Views

    out = text_queries.g06(Views(spark, "/root/testdata/sf0.001"))
    text = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    dealt = [part for part in text.split("\n\n") if "REPARTITION_BY_NUM" in part]
    assert len(dealt) == 1 and "shuffle_key" not in dealt[0].split("Arguments")[0] and "blocks" not in dealt[0]
    assert text.count("Avg Rating") == 2  # both sides' lines are rendered once, behind the shuffle
