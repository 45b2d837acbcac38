"""Queries F1-F16 and P1-P18."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrid.functions import scalars as S
from matchgrid.operators import projections as P
from matchgrid.plans.registry import query

c, lit = F.col, F.lit


@query("f01_result_from_score", "SELECT fixture_id, CASE WHEN home_goals > away_goals THEN 'home_win' WHEN home_goals < away_goals THEN 'away_win' ELSE 'draw' END AS result FROM matches")
def f01(v):
    return v.matches.select("fixture_id", S.result_from_score(c("home_goals"), c("away_goals")).alias("result"))


@query("f02_over_under", "SELECT fixture_id, CASE WHEN home_goals + away_goals > 3 THEN 'over' ELSE 'under' END AS side FROM matches")
def f02(v):
    return v.matches.select("fixture_id", S.over_under(c("home_goals") + c("away_goals"), 3).alias("side"))


P_OVER_SQL = "CASE WHEN x <= 0 THEN 0.0::DOUBLE ELSE round(least(greatest(1 - (exp(-x) + exp(-x) * x + exp(-x) * x * x / 2), 0), 1), 9) END"


@query("f03_p_over", f"SELECT fixture_id, {P_OVER_SQL} AS p FROM (SELECT fixture_id, ((home_goals + away_goals) / 2)::DOUBLE AS x FROM matches)")
def f03(v):
    rate = (c("home_goals") + c("away_goals")).cast("double") / 2
    return v.matches.select("fixture_id", F.round(S.p_over(rate, 2.5), 9).alias("p"))


@query(
    "f04_kelly",
    "SELECT fixture_id, round(greatest(0.0::DOUBLE, (0.9::DOUBLE * p - (1 - p)) / 0.9::DOUBLE), 9) AS fraction FROM (SELECT fixture_id, (fixture_id % 100) / 100.0::DOUBLE AS p FROM matches)",
)
def f04(v):
    return v.matches.select("fixture_id", F.round(S.kelly((c("fixture_id") % 100).cast("double") / 100.0, lit(1.9)), 9).alias("fraction"))


WILSON_SQL = """round(s / n, 9) AS rate,
  round(greatest(0, (s / n + z * z / (2 * n) - z * sqrt(s / n * (1 - s / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS low,
  round(least(1, (s / n + z * z / (2 * n) + z * sqrt(s / n * (1 - s / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS high"""


def rounded_wilson(s, n):
    w = S.wilson(s, n)
    return [F.round(w[x], 9).alias(x) for x in ("rate", "low", "high")]


@query(
    "f05_wilson",
    f"SELECT season, {WILSON_SQL} FROM (SELECT season, sum(CASE WHEN home_goals > away_goals THEN 1 ELSE 0 END)::DOUBLE AS s, count(*)::DOUBLE AS n, 1.959963984540054::DOUBLE AS z FROM matches GROUP BY season)",
)
def f05(v):
    g = v.matches.groupBy("season").agg(F.count_if(c("home_goals") > c("away_goals")).alias("s"), F.count("*").alias("n"))
    return g.select("season", *rounded_wilson(c("s"), c("n")))


@query(
    "f06_parse_measure",
    "SELECT p_partkey, try_cast(regexp_replace(trim(t), ' ?(cm)?(kg)?$', '') AS DOUBLE) AS measure, try_cast(regexp_replace(t, '[^0-9]', '', 'g') AS BIGINT) AS digits FROM "
    "(SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ' cm') WHEN 1 THEN concat(p_size, '.5 kg') WHEN 2 THEN 'tall' ELSE NULL END AS t FROM part)",
)
def f06(v):
    t = F.when(c("p_partkey") % 4 == 0, F.concat("p_size", lit(" cm"))).when(c("p_partkey") % 4 == 1, F.concat("p_size", lit(".5 kg"))).when(c("p_partkey") % 4 == 2, "tall")
    return v.part.select("p_partkey", S.parse_measure(t).alias("measure"), S.parse_measure_int(t).alias("digits"))


@query("f07_slug", "SELECT n_nationkey, replace(replace(replace(lower(n_name), ' ', '_'), '-', '_'), '''', '') AS slug FROM nation")
def f07(v):
    return v.nation.select("n_nationkey", S.slug(c("n_name")).alias("slug"))


@query(
    "f08_fmt_or_dash",
    "SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_discount = 0 THEN '-' ELSE printf('%.1f', round_even(l_discount * 100, 1)) END AS one, "
    "CASE WHEN l_linenumber = 0 THEN '-' ELSE CAST(l_linenumber AS VARCHAR) END AS whole FROM lineitem",
)
def f08(v):
    return v.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", S.fmt_or_dash(c("l_discount") * 100, 1).alias("one"), S.fmt_or_dash(c("l_linenumber"), 0, whole=True).alias("whole"))


@query(
    "f09_parse_timestamp",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('day', ts) WHEN 3 THEN NULL ELSE date_trunc('second', ts) END::TIMESTAMP AS t FROM events",
)
def f09(v):
    text = F.when(c("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd")).when(c("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(c("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    return v.events.select("event_id", S.parse_timestamp(text).alias("t"))


@query("f10_epoch_to_ts", "SELECT event_id, make_timestamp((1600000000 + event_id * 60) * 1000000) AS t FROM events")
def f10(v):
    return v.events.select("event_id", S.epoch_to_ts(lit(1600000000) + c("event_id") * 60).alias("t"))


@query("f11_time_parts", "SELECT fixture_id, dayname(ts) AS day, month(ts)::INT AS month, hour(ts)::INT AS hour, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM matches")
def f11(v):
    return v.matches.select("fixture_id", F.date_format("ts", "EEEE").alias("day"), F.month("ts").alias("month"), F.hour("ts").alias("hour"), S.iso_text(c("ts")).alias("iso"))


@query(
    "f12_pct_text",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE WHEN p_partkey % 3 = 1 THEN NULL ELSE p_size::DOUBLE END AS pct, replace(replace(lower(p_type), ' ', '_'), '%', 'pct') AS key FROM part",
)
def f12(v):
    t = F.when(c("p_partkey") % 3 == 0, F.concat("p_size", lit("%"))).when(c("p_partkey") % 3 == 1, "n/a").otherwise(c("p_size").cast("string"))
    return v.part.select("p_partkey", S.pct_text(t).alias("pct"), S.stat_key(c("p_type")).alias("key"))


@query(
    "f13_anonymise",
    "SELECT fixture_id, CASE WHEN length(home_team_name) >= length(away_team_name) THEN replace(replace(t, home_team_name, 'Team A'), away_team_name, 'Team B') "
    "ELSE replace(replace(t, away_team_name, 'Team B'), home_team_name, 'Team A') END AS text FROM (SELECT *, concat(home_team_name, ' beat ', away_team_name, '; ', home_team_name, ' played well') AS t FROM matches)",
)
def f13(v):
    t = F.concat("home_team_name", lit(" beat "), "away_team_name", lit("; "), "home_team_name", lit(" played well"))
    return v.matches.select("fixture_id", S.anonymise(t, c("home_team_name"), c("away_team_name")).alias("text"))


@query(
    "f14_nested_default",
    "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE try_cast(json_extract_string(props, '$.k') AS BIGINT) END, -1) AS k, CASE WHEN event_id % 2 = 0 THEN 'second' ELSE 'none' END AS item FROM events",
)
def f14(v):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    s = v.events.select("event_id", F.when(c("event_id") % 3 != 0, F.struct(k.alias("k"))).alias("p"), F.when(c("event_id") % 2 == 0, F.array(lit("first"), lit("second"))).otherwise(F.array(lit("first"))).alias("a"))
    return s.select("event_id", F.coalesce("p.k", lit(-1)).alias("k"), F.coalesce(F.try_element_at("a", lit(2)), lit("none")).alias("item"))


@query("f15_split_explode", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS part_word FROM part")
def f15(v):
    joined = F.regexp_replace("p_type", " ", ", ")
    return v.part.select("p_partkey", F.explode(F.split(joined, r",\s*")).alias("part_word"))


@query(
    "f16_label_agreement",
    "SELECT fixture_id, regime, anonymized, pred_result = CASE WHEN pred_home > pred_away THEN 'home_win' WHEN pred_home < pred_away THEN 'away_win' ELSE 'draw' END AS agrees FROM predictions",
)
def f16(v):
    return v.predictions.select("fixture_id", "regime", "anonymized", (c("pred_result") == S.result_from_score(c("pred_home"), c("pred_away"))).alias("agrees"))


@query(
    "p01_coerce_numeric",
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE try_cast(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events",
)
def p01(v):
    text = F.when(c("event_id") % 5 == 0, "n/a").otherwise(F.get_json_object("props", "$.k"))
    return P.coerce_numeric(v.events.select("event_id", text.alias("k")), ["k"])


RATES_SQL = """round_even(goals / nullif(minutes, 0) * 90, 2) AS goals_per_90, round_even(assists / nullif(minutes, 0) * 90, 2) AS assists_per_90,
  round_even((goals + assists) / nullif(minutes, 0) * 90, 2) AS goal_contributions_per_90, round_even(shots_on_target / nullif(shots_total, 0) * 100, 1) AS shot_accuracy,
  round_even(duels_won / nullif(duels_total, 0) * 100, 1) AS duel_win_pct, round_even(tackles_total / nullif(minutes, 0) * 90, 2) AS tackles_per_90,
  round_even(dribbles_success / nullif(dribbles_attempts, 0) * 100, 1) AS dribble_success_pct"""
RATES = ["goals_per_90", "assists_per_90", "goal_contributions_per_90", "shot_accuracy", "duel_win_pct", "tackles_per_90", "dribble_success_pct"]


@query("p02_player_rates", f"SELECT player_id, season, {RATES_SQL} FROM player_season")
def p02(v):
    return P.derive_player_rates(v.player_season).select("player_id", "season", *RATES)


PLAYER_MATCH_SQL = """pm AS (SELECT batch_id AS fixture_id, player_id, row_no, rating IS NOT NULL AS appeared, minutes AS minutes_played, goals AS goals_scored, assists AS goals_assists, passes_total, passes_key,
  passes_accuracy, tackles_total, tackles_blocks, tackles_interceptions, duels_total, duels_won, dribbles_attempts, dribbles_success, shots_total, shots_on_target, fouls_committed FROM player_season_raw)"""
FILLED = "goals_assists passes_total passes_key passes_accuracy tackles_total tackles_blocks tackles_interceptions duels_total duels_won dribbles_attempts dribbles_success shots_total shots_on_target fouls_committed".split()


def player_match(v):
    names = {"batch_id": "fixture_id", "minutes": "minutes_played", "goals": "goals_scored", "assists": "goals_assists"}
    cols = ["batch_id", "player_id", "row_no", "minutes", "goals", "assists", *[x for x in FILLED if x != "goals_assists"]]
    return v.player_season_raw.select(*[c(x).alias(names.get(x, x)) for x in cols], c("rating").isNotNull().alias("appeared"))


@query("p03_fill_zero_if_appeared", f"WITH {PLAYER_MATCH_SQL} SELECT fixture_id, player_id, row_no, appeared, " + ", ".join(f"CASE WHEN appeared THEN coalesce({x}, 0) ELSE {x} END AS {x}" for x in FILLED) + " FROM pm")
def p03(v):
    return P.fill_zero_if_appeared(player_match(v)).select("fixture_id", "player_id", "row_no", "appeared", *FILLED)


def _r(a, b, k, d):
    return f"CASE WHEN {b} > 0 THEN round_even({a} / {b} * {k}, {d}) END"


@query(
    "p04_player_match",
    f"WITH {PLAYER_MATCH_SQL} SELECT fixture_id, player_id, row_no, {_r('passes_accuracy', 'passes_total', 100, 1)} AS pass_accuracy_pct, {_r('duels_won', 'duels_total', 100, 1)} AS duel_win_pct, "
    f"{_r('dribbles_success', 'dribbles_attempts', 100, 1)} AS dribble_success_pct, {_r('shots_on_target', 'shots_total', 100, 1)} AS shot_accuracy_pct, {_r('goals_scored', 'shots_total', 1, 3)} AS goals_per_shot, "
    f"{_r('minutes_played', 'goals_scored', 1, 1)} AS minutes_per_goal, tackles_total + tackles_interceptions + tackles_blocks AS defensive_actions, goals_scored + goals_assists + passes_key AS attacking_actions, "
    f"{_r('goals_scored', 'minutes_played', 90, 3)} AS goals_per_90, {_r('goals_assists', 'minutes_played', 90, 3)} AS assists_per_90, {_r('passes_key', 'minutes_played', 90, 3)} AS key_passes_per_90, "
    f"{_r('tackles_total', 'minutes_played', 90, 3)} AS tackles_per_90, {_r('dribbles_success', 'minutes_played', 90, 3)} AS successful_dribbles_per_90, {_r('fouls_committed', 'minutes_played', 90, 3)} AS fouls_committed_per_90 FROM pm",
)
def p04(v):
    names = "pass_accuracy_pct duel_win_pct dribble_success_pct shot_accuracy_pct goals_per_shot minutes_per_goal defensive_actions attacking_actions goals_per_90 assists_per_90 key_passes_per_90 tackles_per_90 successful_dribbles_per_90 fouls_committed_per_90"
    return P.derive_player_match(player_match(v)).select("fixture_id", "player_id", "row_no", *names.split())


@query(
    "p05_match_features",
    "SELECT fixture_id, dayname(ts) AS day_of_week, month(ts)::INT AS match_month, hour(ts)::INT AS match_hour, coalesce(contains(lower(round), 'group'), false) AS is_group_stage, "
    "NOT coalesce(contains(lower(round), 'group'), false) AS is_knockout, home_goals + away_goals AS total_goals, abs(home_goals - away_goals) AS goal_difference, home_goals - away_goals AS home_goal_diff, "
    "CASE WHEN home_goals > away_goals THEN 'home_win' WHEN home_goals < away_goals THEN 'away_win' ELSE 'draw' END AS match_result, coalesce(went_to_penalties, false) AS decided_by_penalties, "
    "coalesce(went_to_extra_time, false) AND NOT coalesce(went_to_penalties, false) AS decided_by_extra_time, NOT coalesce(went_to_extra_time, false) AS decided_in_regular_time, "
    "home_goals + away_goals >= 4 AS is_high_scoring, away_goals = 0 AS is_clean_sheet_home, home_goals = 0 AS is_clean_sheet_away FROM matches",
)
def p05(v):
    return P.derive_match_features(v.matches).drop(*[x for x in v.matches.columns if x != "fixture_id"])


@query(
    "p06_event_features",
    "SELECT event_id, CASE WHEN greatest(time_elapsed, 0) <= 15 THEN '0-15' WHEN time_elapsed <= 30 THEN '16-30' WHEN time_elapsed <= 45 THEN '31-45' WHEN time_elapsed <= 60 THEN '46-60' "
    "WHEN time_elapsed <= 75 THEN '61-75' WHEN time_elapsed <= 90 THEN '76-90' WHEN time_elapsed <= 120 THEN '91-105' ELSE '106-120' END AS time_bucket, time_elapsed BETWEEN 0 AND 45 AS is_first_half, "
    "time_elapsed > 45 AND time_elapsed <= 90 AS is_second_half, time_elapsed > 90 AS is_extra_time, coalesce(time_extra > 0, false) AS is_injury_time, time_elapsed >= 80 AS is_late_event FROM match_events",
)
def p06(v):
    return P.derive_event_features(v.match_events).select("event_id", "time_bucket", "is_first_half", "is_second_half", "is_extra_time", "is_injury_time", "is_late_event")


FLAGS_SQL = """SELECT *, pred_r = gt_r AS correct_result, pred_home = gt_home AND pred_away = gt_away AS correct_score, (pred_total > 2.5) = (gt_total > 2.5) AS correct_direction, pred_total > 2.5 AS pred_over, gt_total > 2.5 AS gt_over
FROM (SELECT *, CASE WHEN gt_home > gt_away THEN 'home_win' WHEN gt_home < gt_away THEN 'away_win' ELSE 'draw' END AS gt_r, CASE WHEN pred_home > pred_away THEN 'home_win' WHEN pred_home < pred_away THEN 'away_win' ELSE 'draw' END AS pred_r,
  gt_home + gt_away AS gt_total, pred_home + pred_away AS pred_total FROM predictions)"""


@query("p08_prediction_flags", f"SELECT fixture_id, regime, anonymized, gt_total, pred_total, pred_over, gt_over, correct_result, correct_score, correct_direction FROM ({FLAGS_SQL})")
def p08(v):
    return P.derive_prediction_flags(v.predictions).select("fixture_id", "regime", "anonymized", "gt_total", "pred_total", "pred_over", "gt_over", "correct_result", "correct_score", "correct_direction")


@query("p09_expand_codes", "SELECT l_orderkey, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned' ELSE l_returnflag END AS l_returnflag FROM lineitem")
def p09(v):
    return P.expand_codes(v.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"), "l_returnflag", {"A": "Accepted", "R": "Returned"})


MODEL_COLUMNS = ["goals", "assists", "shots_total", "passes_key", "tackles_total", "dribbles_success"]


@query(
    "p10_format_for_model",
    "SELECT player_id, season, " + ", ".join(f"coalesce({x}, 0) AS {x}, round(coalesce({x} / nullif(minutes, 0) * 90, 0), 9) AS {x}_per_90" for x in MODEL_COLUMNS) + " FROM player_season",
)
def p10(v):
    out = P.format_for_model(v.player_season.select("player_id", "season", "minutes", *MODEL_COLUMNS), MODEL_COLUMNS)
    return out.select("player_id", "season", *MODEL_COLUMNS, *[F.round(f"{x}_per_90", 9).alias(f"{x}_per_90") for x in MODEL_COLUMNS])


@query("p11_align_schema", "SELECT player_id AS id, upper(player_name) AS name, age::DOUBLE AS age, 'squad' AS origin FROM squads")
def p11(v):
    return P.align_schema(v.squads, {"id": "player_id", "name": F.upper("player_name"), "age": c("age").cast("double"), "origin": lit("squad")})


@query("p12_complete_columns", "SELECT team_id, team_name, NULL::VARCHAR AS venue, NULL::BIGINT AS capacity FROM teams")
def p12(v):
    return P.complete_columns(v.teams, {"team_id": "bigint", "team_name": "string", "venue": "string", "capacity": "bigint"})


@query("p13_time_range", "SELECT fixture_id, ts FROM matches WHERE ts >= TIMESTAMP '1994-01-01' AND ts < TIMESTAMP '2010-01-01'")
def p13(v):
    return P.time_range(v.matches.select("fixture_id", "ts"), "ts", "1994-01-01", "2010-01-01")


@query("p17_complete_for_regime", "SELECT fixture_id, halftime_home, halftime_away FROM matches WHERE halftime_home IS NOT NULL AND halftime_away IS NOT NULL")
def p17(v):
    return P.complete_for_regime(v.matches, "halftime").select("fixture_id", "halftime_home", "halftime_away")


@query("p18_first_half_events", "SELECT event_id, fixture_id, time_elapsed, event_type FROM match_events WHERE time_elapsed BETWEEN 0 AND 45 AND event_type IN ('Goal', 'Card')")
def p18(v):
    return P.first_half_events(v.match_events).select("event_id", "fixture_id", "time_elapsed", "event_type")
