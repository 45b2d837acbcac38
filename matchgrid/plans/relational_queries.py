"""Queries J1-J18, A1-A17, W1-W10, T1-T5, U1-U5 and P14-P16."""

from __future__ import annotations


from pyspark.sql import functions as F

from matchgrid.operators import aggregates as A
from matchgrid.operators import joins as J
from matchgrid.operators import projections as P
from matchgrid.operators import windows as W
from matchgrid.plans.projection_queries import RATES_SQL
from matchgrid.plans.registry import query
from matchgrid.plans.views import MEANS, SUMS, VIEWS

c, lit = F.col, F.lit

# -- filters -----------------------------------------------------------------------------------


@query("p14_starters", "SELECT fixture_id, player_id, team_id FROM lineups WHERE is_starter")
def p14(v):
    return v.lineups.filter("is_starter").select("fixture_id", "player_id", "team_id")


@query("p15_name_search", "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'an')")
def p15(v):
    return v.nation.filter(F.lower("n_name").contains("AN".lower())).select("n_nationkey", "n_name")


@query("p16_temporal_split", "SELECT fixture_id, CASE WHEN season < 2000 THEN 'train' ELSE 'eval' END AS part FROM matches WHERE season <= 2000")
def p16(v):
    train, held = v.matches.filter("season < 2000"), v.matches.filter("season = 2000")
    return train.select("fixture_id", lit("train").alias("part")).unionAll(held.select("fixture_id", lit("eval").alias("part")))


# -- aggregations over player seasons ----------------------------------------------------------

DEDUP_SQL = "(SELECT * FROM player_season_raw QUALIFY row_number() OVER (PARTITION BY player_id, season, team_id, league_id ORDER BY source <> 'career', batch_id, row_no) = 1)"


def deduplicated(v):
    return W.keep_preferred(raw_by_player(v), ["player_id", "season", "team_id", "league_id"], ties=["batch_id", "row_no"])


def raw_by_player(v):
    """The raw rows dealt by player and season while they are lineitem's own, a third as wide; groupings
    that begin with both need no other shuffle."""
    rows = v.lineitem.repartition("l_suppkey", F.year("l_shipdate").cast("int"))
    return v.spark.sql(VIEWS["player_season_raw"], lineitem=rows)


@query("w01_keep_preferred", f"SELECT player_id, season, team_id, league_id, source, batch_id, row_no FROM {DEDUP_SQL}")
def w01(v):
    return deduplicated(v).select("player_id", "season", "team_id", "league_id", "source", "batch_id", "row_no")


@query(
    "w02_keep_newest",
    "SELECT player_id, season, team_id, batch_id, row_no FROM player_season_raw QUALIFY row_number() OVER (PARTITION BY player_id, season, team_id ORDER BY batch_id DESC, row_no DESC) = 1",
)
def w02(v):
    return W.keep_newest(v.player_season_raw, ["player_id", "season", "team_id"], "batch_id", ["row_no"]).select("player_id", "season", "team_id", "batch_id", "row_no")


@query("a01_player_seasons", "SELECT player_id, season, " + ", ".join(f"sum({x}) AS {x}" for x in SUMS) + ", " + ", ".join(f"round(avg({x}), 9) AS {x}" for x in MEANS) + f" FROM {DEDUP_SQL} GROUP BY player_id, season")
def a01(v):
    out = A.aggregate_player_seasons(deduplicated(v), SUMS, MEANS)
    return out.withColumns({x: F.round(x, 9) for x in MEANS})


META = ["nationality", "position", "height_cm", "league_id"]


@query(
    "a02_first_known_meta",
    "SELECT player_id, " + ", ".join(f"arg_min({x}, k) FILTER ({x} IS NOT NULL) AS {x}" for x in META) + " FROM (SELECT *, (season, batch_id, row_no) AS k FROM player_season_raw) GROUP BY player_id",
)
def a02(v):
    return A.first_known_meta(v.player_season_raw, META, order=["season", "batch_id", "row_no"])


@query("j01_attach_player_meta", "SELECT s.player_id, s.season, s.goals, m.height FROM player_season s LEFT JOIN (SELECT player_id, max(height_cm) AS height FROM player_season_raw GROUP BY player_id) m ON s.player_id = m.player_id")
def j01(v):
    meta = v.player_season_raw.groupBy("player_id").agg(F.max("height_cm").alias("height"))
    return J.attach(v.player_season, meta, "player_id").select("player_id", "season", "goals", "height")


@query("j02_attach_registry", "SELECT p.player_id, p.season, s.player_name AS squad_name, s.age FROM player_season p LEFT JOIN squads s ON p.player_id = s.player_id")
def j02(v):
    return J.attach(v.player_season.select("player_id", "season"), J.small(v.squads.select("player_id", c("player_name").alias("squad_name"), "age")), "player_id")


@query(
    "j03_pair_on_match",
    "SELECT a.fixture_id, a.anonymized, a.pred_home AS pred_home_a, b.pred_home AS pred_home_b FROM predictions a JOIN predictions b ON a.fixture_id = b.fixture_id AND a.anonymized = b.anonymized AND a.regime = 'pregame' AND b.regime = 'halftime'",
)
def j03(v):
    p = v.predictions.select("fixture_id", "anonymized", "regime", "pred_home")
    a, b = p.filter("regime = 'pregame'").drop("regime"), p.filter("regime = 'halftime'").drop("regime")
    return J.pair_on_match(a, b, ["fixture_id", "anonymized"])


HISTORY_SQL = """hist AS (SELECT l.fixture_id, l.team_id, l.player_id, l.season, l.number, l.position, p.season AS past, p.position AS past_position, p.rating, p.passes_accuracy, """ + ", ".join(
    f"p.{x}" for x in SUMS
) + f", {RATES_SQL} FROM lineups l JOIN player_season p ON l.player_id = p.player_id AND p.season >= l.season - 3 AND p.season < l.season WHERE l.is_starter)"


def history(v):
    starters = v.lineups.filter("is_starter").select("fixture_id", "team_id", "player_id", "season", "number", "position")
    return J.starters_with_history(starters, P.derive_player_rates(v.player_season))


@query("j04_starters_with_history", f"WITH {HISTORY_SQL} SELECT fixture_id, team_id, player_id, season, past, goals FROM hist")
def j04(v):
    return history(v).select("fixture_id", "team_id", "player_id", "season", "past", "goals")


FORM_SQL = (
    "form AS (SELECT fixture_id, team_id, player_id, number, position, "
    + ", ".join(f"coalesce(sum({x}), 0) AS {x}" for x in SUMS)
    + ", "
    + ", ".join(f"avg({x}) AS {x}" for x in A.RATES)
    + ", count(*) AS seasons_with_data, arg_max(past_position, past) AS form_position FROM hist GROUP BY fixture_id, team_id, player_id, number, position)"
)
FORM_KEYS = ["fixture_id", "team_id", "player_id", "number", "position"]


def lineups_by_match(v):
    """The lineups with lineitem's own columns dealt by order once: they are grouped and meet their matches where they lie."""
    return v.spark.sql(VIEWS["lineups"], lineitem=v.lineitem.repartition("l_orderkey"), matches=v.matches)


def form(v, how="inner", *more):
    starters = lineups_by_match(v).filter("is_starter").select(*FORM_KEYS, "season", *more)
    seasons = P.derive_player_rates(A.player_seasons(v.player_season_raw, SUMS, MEANS))
    return starters.join(A.form_by_season(seasons, SUMS), ["player_id", "season"], how)


@query(
    "a03_lookback_form",
    f"WITH {HISTORY_SQL}, {FORM_SQL} SELECT fixture_id, team_id, player_id, goals, minutes, saves, round(rating, 9) AS rating, round(goals_per_90, 9) AS goals_per_90, seasons_with_data, form_position FROM form",
)
def a03(v):
    return form(v).select("fixture_id", "team_id", "player_id", "goals", "minutes", "saves", F.round("rating", 9).alias("rating"), F.round("goals_per_90", 9).alias("goals_per_90"), "seasons_with_data", "form_position")


PROFILE_COLUMNS = [f"team_total_{x}" for x in A.PROFILE_SUMS] + ["team_avg_rating", "team_avg_passes_accuracy", "team_avg_goals_per_90"]
PROFILE_SQL = (
    "prof AS (SELECT fixture_id, team_id, count(*) AS num_starters_with_data, "
    + ", ".join(f"round_even(round(sum({x}), 9), 1) AS team_total_{x}" for x in A.PROFILE_SUMS)
    + ", "
    + ", ".join(f"round_even(round(avg({x}), 9), 2) AS team_avg_{x}" for x in A.PROFILE_MEANS)
    + " FROM form GROUP BY fixture_id, team_id)"
)
CHAIN_SQL = f"WITH {HISTORY_SQL}, {FORM_SQL}, {PROFILE_SQL}"


def profiles(v):
    return A.team_profile(form(v))


@query("a04_team_profile", f"{CHAIN_SQL} SELECT fixture_id, team_id, num_starters_with_data, {', '.join(PROFILE_COLUMNS[:8])} FROM prof")
def a04(v):
    return profiles(v).select("fixture_id", "team_id", "num_starters_with_data", *PROFILE_COLUMNS[:8])


@query(
    "a05_position_breakdown",
    f"WITH {HISTORY_SQL}, {FORM_SQL} SELECT fixture_id, team_id, coalesce(position, form_position, 'Unknown') AS position, count(*) AS n FROM form GROUP BY ALL",
)
def a05(v):
    return A.position_breakdown(form(v)).select("fixture_id", "team_id", F.explode("position_breakdown").alias("position", "n"))


@query(
    "a06_player_summaries",
    f"WITH {HISTORY_SQL}, {FORM_SQL} SELECT fixture_id, team_id, player_id, (row_number() OVER (PARTITION BY fixture_id, team_id ORDER BY number, player_id) - 1)::INTEGER AS pos, round_even(goals, 2) AS goals, round_even(minutes, 2) AS minutes FROM form",
)
def a06(v):
    out = A.player_summaries(form(v), ["goals", "minutes"]).select("fixture_id", "team_id", F.posexplode("player_summaries").alias("pos", "p"))
    return out.select("fixture_id", "team_id", "p.player_id", "pos", "p.goals", "p.minutes")


@query(
    "j08_two_profiles",
    f"{CHAIN_SQL} SELECT m.fixture_id, h.team_total_goals AS home_goals_form, a.team_total_goals AS away_goals_form, h.num_starters_with_data AS home_starters, a.num_starters_with_data AS away_starters "
    "FROM matches m LEFT JOIN prof h ON m.fixture_id = h.fixture_id AND m.home_team_id = h.team_id LEFT JOIN prof a ON m.fixture_id = a.fixture_id AND m.away_team_id = a.team_id",
)
def j08(v):
    out = J.attach_two_profiles(v.matches.select("fixture_id", "home_team_id", "away_team_id"), profiles(v))
    return out.select("fixture_id", c("home_team_total_goals").alias("home_goals_form"), c("away_team_total_goals").alias("away_goals_form"), c("home_num_starters_with_data").alias("home_starters"), c("away_num_starters_with_data").alias("away_starters"))


def flagship(v):
    return j08(v)


TEAM_MATCH_SQL = """tm AS (SELECT fixture_id, season, home_team_name AS team_name, away_team_name AS opponent_name, home_goals AS scored, away_goals AS conceded FROM matches
  UNION ALL SELECT fixture_id, season, away_team_name, home_team_name, away_goals, home_goals FROM matches)"""


def team_match(v):
    side = lambda us, them: F.struct(c(f"{us}_team_name").alias("team_name"), c(f"{them}_team_name").alias("opponent_name"), c(f"{us}_goals").alias("scored"), c(f"{them}_goals").alias("conceded"))
    return v.matches.select("fixture_id", "season", F.inline(F.array(side("home", "away"), side("away", "home"))))


@query(
    "j05_prior_tournaments",
    f"WITH {TEAM_MATCH_SQL}, ts AS (SELECT team_name, season, count(*) AS n, sum(scored) AS scored FROM tm GROUP BY ALL) SELECT m.fixture_id, sum(t.n)::BIGINT AS n, sum(t.scored)::BIGINT AS scored, max(t.season) AS last FROM matches m JOIN ts t ON m.home_team_name = t.team_name AND t.season < m.season GROUP BY m.fixture_id",
)
def j05(v):
    return J.prior_tournaments(v.matches, team_match(v), "home_team_name")


ORACLE_H2H = (
    "SELECT m.fixture_id, count(p.fixture_id) AS matches, count(*) FILTER (p.home_goals > p.away_goals AND p.home_team_name = m.home_team_name OR p.home_goals < p.away_goals AND p.away_team_name = m.home_team_name) AS team1_wins, "
    "count(*) FILTER (p.home_goals > p.away_goals AND p.home_team_name = m.away_team_name OR p.home_goals < p.away_goals AND p.away_team_name = m.away_team_name) AS team2_wins, count(*) FILTER (p.home_goals = p.away_goals) AS draws "
    "FROM matches m LEFT JOIN matches p ON p.season < m.season AND least(m.home_team_id, m.away_team_id) = least(p.home_team_id, p.away_team_id) AND greatest(m.home_team_id, m.away_team_id) = greatest(p.home_team_id, p.away_team_id) GROUP BY m.fixture_id"
)


@query("j06_head_to_head", ORACLE_H2H)
def j06(v):
    return J.head_to_head(v.matches)


@query(
    "j07_attach_events",
    "SELECT fixture_id, event_id, CASE event_type WHEN 'Goal' THEN 'goals' WHEN 'Card' THEN 'cards' ELSE 'substitutions' END AS kind, "
    "(row_number() OVER (PARTITION BY fixture_id, event_type ORDER BY event_id) - 1)::INTEGER AS pos FROM match_events JOIN matches USING (fixture_id) WHERE event_type <> 'Other'",
)
def j07(v):
    out = J.attach_events(v.matches.select("fixture_id"), v.match_events)
    kinds = [out.select("fixture_id", F.posexplode(k).alias("pos", "e")).select("fixture_id", "e.event_id", lit(k).alias("kind"), "pos") for k in ("goals", "cards", "substitutions")]
    return kinds[0].unionAll(kinds[1]).unionAll(kinds[2])


@query(
    "j09_attach_opponent",
    "SELECT l.fixture_id, l.player_id, l.team_id = m.home_team_id AS is_home, CASE WHEN l.team_id = m.home_team_id THEN m.away_team_id ELSE m.home_team_id END AS opponent_id, "
    "CASE WHEN l.team_id = m.home_team_id THEN m.away_team_name ELSE m.home_team_name END AS opponent_name FROM lineups l LEFT JOIN matches m ON l.fixture_id = m.fixture_id",
)
def j09(v):
    return J.attach_opponent(v.lineups.select("fixture_id", "player_id", "team_id"), v.matches).drop("team_id")


@query("j10_players_of_team", "SELECT * FROM squads WHERE team_id IN (SELECT team_id FROM teams WHERE is_host)")
def j10(v):
    return J.semi(v.squads, v.teams.filter("is_host"), "team_id")


@query("j11_new_teams_only", "SELECT team_id, team_name FROM teams WHERE region_id < 3 UNION ALL SELECT team_id, team_name FROM teams WHERE region_id >= 3")
def j11(v):
    t = v.teams.select("team_id", "team_name", "region_id")
    return J.append_new(t.filter("region_id < 3"), t.filter("region_id >= 1"), "team_id").drop("region_id")


@query(
    "j12_season_gaps",
    "SELECT s.player_id, y.season::INTEGER AS season FROM squads s CROSS JOIN (SELECT unnest([1995, 1998, 2001, 2003]) AS season) y WHERE NOT EXISTS (SELECT 1 FROM player_season p WHERE p.player_id = s.player_id AND p.season = y.season)",
)
def j12(v):
    return J.season_gaps(v.squads, v.player_season, [1995, 1998, 2001, 2003])


STRENGTH_SQL = """st AS (SELECT q.team_id, q.squad_size, q.avg_age, e.avg_experience, f.avg_rating, f.total_goals, f.total_assists, f.total_appearances
FROM (SELECT team_id, count(*) AS squad_size, avg(age) AS avg_age FROM squads GROUP BY team_id) q
JOIN (SELECT team_id, avg(n) AS avg_experience FROM (SELECT s.team_id, s.player_id, count(DISTINCT p.season) AS n FROM squads s LEFT JOIN player_season p ON s.player_id = p.player_id GROUP BY s.team_id, s.player_id) GROUP BY team_id) e ON q.team_id = e.team_id
LEFT JOIN (SELECT s.team_id, avg(p.rating) AS avg_rating, coalesce(sum(p.goals), 0) AS total_goals, coalesce(sum(p.assists), 0) AS total_assists, coalesce(sum(p.appearances), 0) AS total_appearances
  FROM squads s JOIN player_season p ON s.player_id = p.player_id JOIN (SELECT s.team_id, max(p.season) AS season FROM squads s JOIN player_season p ON s.player_id = p.player_id GROUP BY s.team_id) l ON s.team_id = l.team_id AND p.season = l.season GROUP BY s.team_id) f ON q.team_id = f.team_id)"""


@query("a10_team_strength", f"WITH {STRENGTH_SQL} SELECT team_id, squad_size, round(avg_age, 9) AS avg_age, round(avg_experience, 9) AS avg_experience, round(avg_rating, 9) AS avg_rating, total_goals, total_assists, total_appearances FROM st")
def a10(v):
    return A.team_strength(v.squads, v.player_season).withColumns({x: F.round(x, 9) for x in ("avg_age", "avg_experience", "avg_rating")})


@query("j13_attach_strength", f"WITH {STRENGTH_SQL} SELECT t.team_id, t.team_name, st.squad_size, st.total_goals FROM teams t LEFT JOIN st ON t.team_id = st.team_id")
def j13(v):
    return J.attach(v.teams.select("team_id", "team_name"), A.team_strength(v.squads, v.player_season).select("team_id", "squad_size", "total_goals"), "team_id")


@query(
    "w03_strength_rank",
    f"WITH {STRENGTH_SQL}, sc AS (SELECT team_id, coalesce(avg_rating, 0) * 0.4::DOUBLE + coalesce(avg_experience, 0) * 0.3::DOUBLE + coalesce(total_goals, 0) / coalesce(squad_size, 1)::DOUBLE * 0.3::DOUBLE AS strength FROM st) "
    "SELECT team_id, round(strength, 9) AS strength, row_number() OVER (ORDER BY strength DESC, team_id)::INTEGER AS rank FROM sc",
)
def w03(v):
    return W.strength_rank(A.team_strength(v.squads, v.player_season)).select("team_id", F.round("strength", 9).alias("strength"), "rank")


@query("j14_attach_halftime", "SELECT p.fixture_id, p.anonymized, m.halftime_home, m.halftime_away FROM predictions p JOIN matches m ON p.fixture_id = m.fixture_id WHERE p.regime = 'pregame' AND m.halftime_home IS NOT NULL")
def j14(v):
    context = v.matches.filter("halftime_home is not null").select("fixture_id", "halftime_home", "halftime_away")
    return v.predictions.filter("regime = 'pregame'").select("fixture_id", "anonymized").join(context, "fixture_id")


@query("j15_config_grid", "SELECT fixture_id, kelly_fraction, cap FROM matches CROSS JOIN (SELECT unnest([0.125, 0.25, 0.5])::DOUBLE AS kelly_fraction) CROSS JOIN (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS cap)")
def j15(v):
    return J.config_grid(v.matches.select("fixture_id"), [0.125, 0.25, 0.5], [0.05, 0.1, 0.2])


REGISTRY_SQL = """reg AS (SELECT player_id, string_agg(team_id::VARCHAR, ',' ORDER BY since, team_id) AS teams FROM (SELECT player_id, team_id, min(season) AS since FROM player_season_raw GROUP BY player_id, team_id) GROUP BY player_id)"""


@query("a13_player_registry", f"WITH {REGISTRY_SQL} SELECT r.player_id, r.teams, y.years, 'Player ' || r.player_id AS player_name FROM reg r JOIN (SELECT player_id, string_agg(DISTINCT season::VARCHAR, ',' ORDER BY season::VARCHAR) AS years FROM player_season_raw GROUP BY player_id) y ON r.player_id = y.player_id")
def a13(v):
    text = lambda x: F.array_join(F.transform(x, lambda e: e.cast("string")), ",")
    return A.player_registry(v.player_season_raw).select("player_id", text("teams").alias("teams"), text("years").alias("years"), "player_name")


@query("j16_membership_expand", f"WITH {REGISTRY_SQL} SELECT player_id, unnest(string_split(teams, ',')) AS team FROM reg")
def j16(v):
    reg = A.player_registry(v.player_season_raw).select("player_id", F.array_join(F.transform("teams", lambda e: e.cast("string")), ", ").alias("wc_teams"))
    return J.membership_expand(reg)


@query("j17_fixtures_of_teams", "SELECT fixture_id FROM matches WHERE home_team_id IN (1, 2, 3) OR away_team_id IN (1, 2, 3)")
def j17(v):
    return J.fixtures_of_teams(v.matches, v.teams.filter(c("team_id").isin(1, 2, 3))).select("fixture_id")


@query("j18_pending_keys", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def j18(v):
    return J.pending_keys(v.orders, v.lineitem.filter("l_linenumber = 1").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey")


# -- other aggregations ------------------------------------------------------------------------


@query("a07_squad_counts", "SELECT fixture_id, player_id, team_id, count(*) OVER w AS squad_size, count(*) FILTER (is_substitute) OVER w AS num_substitutes FROM lineups WINDOW w AS (PARTITION BY fixture_id, team_id)")
def a07(v):
    return A.squad_counts(v.lineups).select("fixture_id", "player_id", "team_id", "squad_size", "num_substitutes")


@query(
    "a08_career_totals",
    "SELECT player_id, player_name, nationality, coalesce(sum(goals), 0) AS goals, coalesce(sum(assists), 0) AS assists, coalesce(sum(minutes), 0) AS minutes, coalesce(sum(tackles_total), 0) AS tackles_total, round(avg(rating), 9) AS rating, "
    "min(season) AS first_season, max(season) AS last_season, count(DISTINCT season) AS seasons, round(coalesce(sum(goals), 0) / nullif(coalesce(sum(minutes), 0), 0) * 90, 9) AS goals_per_90 FROM player_season_raw GROUP BY ALL",
)
def a08(v):
    out = A.career_totals(v.player_season_raw, ["goals", "assists", "minutes", "tackles_total"]).drop("assists_per_90", "tackles_total_per_90")
    return out.withColumns({x: F.round(x, 9) for x in ("rating", "goals_per_90")})


@query(
    "a09_career_summary",
    "SELECT s.player_id, m.position AS main_position, seasons, teams, leagues, goals, minutes FROM (SELECT player_id, count(DISTINCT season) AS seasons, count(DISTINCT team_id) AS teams, count(DISTINCT league_id) AS leagues, coalesce(sum(goals), 0) AS goals, "
    "coalesce(sum(minutes), 0) AS minutes FROM player_season_raw GROUP BY player_id) s LEFT JOIN (SELECT player_id, position FROM (SELECT player_id, position, count(*) AS n FROM player_season_raw WHERE position IS NOT NULL GROUP BY ALL) "
    "QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY n DESC, position) = 1) m ON s.player_id = m.player_id",
)
def a09(v):
    return A.career_summary(v.player_season_raw)


_is = lambda col, *names: f"coalesce({col} IN ({', '.join(repr(n) for n in names)}), false)"
_T = lambda t, cond="true": f"type = '{t}' AND {cond}"
_L = "coalesce(length, 0) > 32"
_CARD = "type IN ('Foul Committed', 'Bad Behaviour')"
MEASURES_SQL = {
    "total_shots": _T("Shot"), "shots_on_target": _T("Shot", _is("outcome", "Goal", "Saved")), "shots_off_target": _T("Shot", _is("outcome", "Off T", "Wayward", "Post")), "shots_blocked": _T("Shot", _is("outcome", "Blocked")),
    "shots_open_play": _T("Shot", _is("subtype", "Open Play")), "shots_free_kick": _T("Shot", _is("subtype", "Free Kick")), "shots_penalty": _T("Shot", _is("subtype", "Penalty")),
    "shots_right_foot": _T("Shot", _is("body_part", "Right Foot")), "shots_left_foot": _T("Shot", _is("body_part", "Left Foot")), "shots_header": _T("Shot", _is("body_part", "Head")),
    "total_passes": _T("Pass"), "passes_completed": _T("Pass", "outcome IS NULL"), "passes_incomplete": _T("Pass", "outcome IS NOT NULL"), "long_passes": _T("Pass", _L), "long_passes_completed": _T("Pass", f"{_L} AND outcome IS NULL"),
    "short_passes": _T("Pass", f"NOT {_L} AND NOT {_is('subtype', 'Corner', 'Free Kick', 'Goal Kick', 'Throw-in', 'Kick Off')}"),
    "ground_passes": _T("Pass", _is("height", "Ground Pass")), "low_passes": _T("Pass", _is("height", "Low Pass")), "high_passes": _T("Pass", _is("height", "High Pass")),
    "through_balls": _T("Pass", _is("technique", "Through Ball")), "crosses": _T("Pass", "is_cross"), "corners": _T("Pass", _is("subtype", "Corner")), "free_kicks": _T("Pass", _is("subtype", "Free Kick")),
    "goal_kicks": _T("Pass", _is("subtype", "Goal Kick")), "throw_ins": _T("Pass", _is("subtype", "Throw-in")), "kick_offs": _T("Pass", _is("subtype", "Kick Off")),
    "fouls_committed": _T("Foul Committed"), "fouls_won": _T("Foul Won"), "handballs": _T("Foul Committed", _is("subtype", "Handball")),
    "yellow_cards": f"{_CARD} AND {_is('card', 'Yellow Card', 'Second Yellow')}", "red_cards": f"{_CARD} AND {_is('card', 'Red Card', 'Second Yellow')}", "second_yellows": f"{_CARD} AND {_is('card', 'Second Yellow')}",
    "offsides": _T("Pass", _is("outcome", "Pass Offside")), "clearances": _T("Clearance"), "interceptions": _T("Interception"), "blocks": _T("Block"), "ball_recoveries": _T("Ball Recovery"),
    "tackles": _T("Duel", _is("subtype", "Tackle")), "tackles_won": _T("Duel", f"{_is('subtype', 'Tackle')} AND {_is('outcome', 'Won', 'Success In Play')}"), "aerial_duels_lost": _T("Duel", _is("subtype", "Aerial Lost")),
    "pressures": _T("Pressure"), "dribbles_attempted": _T("Dribble"), "dribbles_completed": _T("Dribble", _is("outcome", "Won", "Complete")), "dispossessed": _T("Dispossessed"), "miscontrols": _T("Miscontrol"),
    "gk_saves": _T("Goal Keeper", _is("subtype", "Shot Saved")), "gk_punches": _T("Goal Keeper", _is("subtype", "Punch")), "gk_claims": _T("Goal Keeper", _is("subtype", "Collected")), "gk_sweeper": _T("Goal Keeper", _is("subtype", "Keeper Sweeper")),
    "substitutions": _T("Substitution"), "fifty_fiftys": _T("50/50"),
}
OWN_SQL = (
    "own AS (SELECT match_id, team, " + ", ".join(f"count(*) FILTER ({cond}) AS {n}" for n, cond in MEASURES_SQL.items())
    + ", round_even(sum(CASE WHEN type = 'Shot' THEN xg ELSE 0 END), 4) AS xg, coalesce(round_even(avg(coalesce(length, 0)) FILTER (type = 'Pass'), 2), 0) AS avg_pass_length FROM plays GROUP BY match_id, team)"
)
TEAM_STATS_SQL = f"{OWN_SQL}, ts AS (SELECT o.*, x.team AS opponent, x.xg AS xg_conceded, x.aerial_duels_lost AS aerial_duels_won, o.aerial_duels_lost AS aerial_duels, x.aerial_duels_lost + o.aerial_duels_lost AS aerial_duels_total FROM own o JOIN own x ON o.match_id = x.match_id AND o.team <> x.team)"


@query("a11_team_match_stats", f"WITH {TEAM_STATS_SQL} SELECT * FROM ts")
def a11(v):
    return A.team_match_stats(v.plays)


POSSESSION_SQL = """poss AS (SELECT t.match_id, t.team, CASE WHEN n.n = 0 THEN 50.0::DOUBLE ELSE round_even(coalesce(h.k, 0) * 100.0::DOUBLE / n.n, 1) END AS ball_possession_pct, coalesce(h.s, 0) AS possession_sequences
FROM (SELECT DISTINCT match_id, team FROM plays) t JOIN (SELECT match_id, count(possession_team) AS n FROM plays GROUP BY match_id) n ON t.match_id = n.match_id
LEFT JOIN (SELECT match_id, possession_team AS team, count(*) AS k, count(DISTINCT possession) AS s FROM plays GROUP BY ALL) h ON t.match_id = h.match_id AND t.team = h.team)"""


@query("a12_possession_share", f"WITH {POSSESSION_SQL} SELECT * FROM poss")
def a12(v):
    return A.possession_share(v.plays)


_z = lambda a, b, k, d: f"CASE WHEN {b} > 0 THEN round_even({a} / ({b})::DOUBLE * {k}, {d}) ELSE 0 END::DOUBLE"
P07_SQL = {
    "shot_accuracy": _z("shots_on_target", "total_shots", 100, 1), "shot_conversion_rate": _z("goals_scored", "total_shots", 100, 1), "xg_per_shot": _z("xg", "total_shots", 1, 4),
    "xg_overperformance": "round_even(goals_scored - xg, 4)", "xg_differential": "round_even(xg - xg_conceded, 4)", "pass_completion_pct": _z("passes_completed", "total_passes", 100, 1),
    "long_pass_completion_pct": _z("long_passes_completed", "long_passes", 100, 1), "long_pass_ratio": _z("long_passes", "total_passes", 100, 1), "cross_ratio": _z("crosses", "total_passes", 100, 1),
    "tackle_success_rate": _z("tackles_won", "tackles", 100, 1), "aerial_win_pct": _z("aerial_duels_won", "aerial_duels_total", 100, 1), "defensive_actions": "tackles + interceptions + clearances + blocks", "pressure_intensity": "pressures",
    "recoveries_per_possession_lost": "CASE WHEN dispossessed + miscontrols > 0 THEN round_even(ball_recoveries / (dispossessed + miscontrols)::DOUBLE, 2) ELSE ball_recoveries END::DOUBLE",
    "dribble_success_rate": _z("dribbles_completed", "dribbles_attempted", 100, 1), "discipline_index": "round_even(yellow_cards + red_cards * 3 + fouls_committed * 0.1::DOUBLE, 2)", "goal_difference": "goals_scored - goals_conceded",
    "match_result": "CASE WHEN goals_scored > goals_conceded THEN 'W' WHEN goals_scored < goals_conceded THEN 'L' ELSE 'D' END", "is_clean_sheet": "(goals_conceded = 0)::INTEGER", "possession_differential": "round_even(ball_possession_pct - 50, 1)",
    "set_piece_passes": "corners + free_kicks + throw_ins + goal_kicks", "set_piece_ratio": _z("(corners + free_kicks + throw_ins + goal_kicks)", "total_passes", 100, 1), "gk_total_actions": "gk_saves + gk_punches + gk_claims + gk_sweeper",
}


@query(
    "p07_team_match",
    f"WITH {TEAM_STATS_SQL}, {POSSESSION_SQL}, g AS (SELECT ts.*, poss.ball_possession_pct, ts.shots_on_target AS goals_scored, x.shots_on_target AS goals_conceded FROM ts JOIN poss USING (match_id, team) JOIN own x ON x.match_id = ts.match_id AND x.team = ts.opponent) "
    "SELECT match_id, team, " + ", ".join(f"{e} AS {n}" for n, e in P07_SQL.items()) + " FROM g",
)
def p07(v):
    stats = A.team_match_stats(v.plays)
    scored = stats.withColumn("goals_scored", c("shots_on_target"))
    other = stats.select("match_id", c("team").alias("opponent"), c("shots_on_target").alias("goals_conceded"))
    joined = scored.join(A.possession_share(v.plays), ["match_id", "team"]).join(other, ["match_id", "opponent"])
    return P.derive_team_match(joined).select("match_id", "team", *P07_SQL)


@query(
    "a14_season_report",
    "SELECT m.*, t.teams, coalesce(l.with_lineups, 0) AS with_lineups, coalesce(e.n_goal, 0) AS n_goal, coalesce(e.n_card, 0) AS n_card, coalesce(e.n_substitution, 0) AS n_substitution FROM "
    "(SELECT season, count(*) AS matches, count(*) FILTER (went_to_extra_time) AS extra_time, count(*) FILTER (went_to_penalties) AS penalties, sum(home_goals + away_goals)::BIGINT AS goals FROM matches GROUP BY season) m "
    "JOIN (SELECT season, count(DISTINCT t) AS teams FROM (SELECT season, home_team_name AS t FROM matches UNION SELECT season, away_team_name FROM matches) GROUP BY season) t ON m.season = t.season "
    "LEFT JOIN (SELECT season, count(DISTINCT fixture_id) AS with_lineups FROM lineups GROUP BY season) l ON m.season = l.season "
    "LEFT JOIN (SELECT season, count(*) FILTER (event_type = 'Goal') AS n_goal, count(*) FILTER (event_type = 'Card') AS n_card, count(*) FILTER (event_type = 'Substitution') AS n_substitution FROM match_events JOIN matches USING (fixture_id) GROUP BY season) e ON m.season = e.season",
)
def a14(v):
    return A.season_report(v.matches, v.lineups, v.match_events)


@query(
    "a15_sample_size_stats",
    "SELECT role, count(*) AS samples, min(length(text)) AS min_chars, round(avg(length(text)), 6) AS avg_chars, max(length(text)) AS max_chars, max(length(text)) // 4 AS max_tokens, max(length(text)) // 4 > 625 AS over_budget FROM conversations GROUP BY role",
)
def a15(v):
    out = A.sample_size_stats(v.conversations, "role", c("text"))
    return out.withColumns({"min_chars": c("min_chars").cast("long"), "max_chars": c("max_chars").cast("long"), "avg_chars": F.round("avg_chars", 6), "max_tokens": c("max_tokens").cast("long")})


COMPLETE = ["league_id", "rating", "height_cm", "assists"]


@query(
    "a16_column_completeness",
    " UNION ALL ".join(f"SELECT '{x}' AS \"column\", count(*) AS rows, count({x}) AS known, count(*) FILTER ({x} > 0) AS positive, round_even(count({x}) * 100.0::DOUBLE / count(*), 1) AS pct FROM player_season_raw" for x in COMPLETE),
)
def a16(v):
    return A.column_completeness(v.player_season_raw, COMPLETE)


@query(
    "a17_table_overview",
    "SELECT count(*) AS rows, 6::BIGINT AS columns, count(DISTINCT player_id) AS players, count(DISTINCT team_id) AS teams, min(season) AS first_season, max(season) AS last_season, string_agg(DISTINCT season::VARCHAR, ',' ORDER BY season::VARCHAR) AS seasons FROM player_season_raw",
)
def a17(v):
    return A.table_overview(v.player_season_raw.select("player_id", "team_id", "season", "goals", "minutes", "rating"))


# -- windows, orderings, sets ------------------------------------------------------------------


@query("w06_last_n", f"WITH {TEAM_MATCH_SQL} SELECT team_name, fixture_id, row_number() OVER (PARTITION BY team_name ORDER BY season DESC, fixture_id DESC)::INTEGER AS nth FROM tm QUALIFY nth <= 3")
def w06(v):
    return W.last_n(team_match(v), ["team_name"], [F.desc("season"), F.desc("fixture_id")], 3).select("team_name", "fixture_id", "nth")


@query("w07_rolling_mean", "SELECT event_id, round(avg(price) OVER (PARTITION BY symbol ORDER BY time_ns, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean_price FROM fills")
def w07(v):
    return W.rolling_mean(v.fills, ["symbol"], ["time_ns", "event_id"], "price", 10, "mean_price").select("event_id", F.round("mean_price", 6).alias("mean_price"))


@query(
    "w08_flow_imbalance",
    "SELECT event_id, round((b - s)::DOUBLE / nullif(b + s, 0), 9) AS flow_imbalance FROM (SELECT event_id, sum(CASE WHEN taker_side = 'BUY' THEN quantity ELSE 0 END) OVER w AS b, sum(CASE WHEN taker_side = 'SELL' THEN quantity ELSE 0 END) OVER w AS s "
    "FROM fills WINDOW w AS (PARTITION BY symbol ORDER BY time_ns, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))",
)
def w08(v):
    return W.rolling_flow_imbalance(v.fills, ["symbol"], ["time_ns", "event_id"], 20).select("event_id", F.round("flow_imbalance", 9).alias("flow_imbalance"))


@query("w09_every_nth", "SELECT event_id, symbol, nth::INTEGER AS nth FROM (SELECT event_id, symbol, row_number() OVER (PARTITION BY symbol ORDER BY time_ns, event_id) AS nth FROM order_events WHERE price > 0 AND quantity > 0) WHERE nth % 10 = 0")
def w09(v):
    return W.every_nth(v.order_events.filter("price > 0 and quantity > 0"), ["symbol"], ["time_ns", "event_id"], 10).select("event_id", "symbol", "nth")


@query("w10_cumulative_counters", "SELECT event_id, count(*) OVER w AS total_trades, (sum(quantity) OVER w)::BIGINT AS total_volume FROM fills WINDOW w AS (PARTITION BY symbol ORDER BY time_ns, event_id ROWS UNBOUNDED PRECEDING)")
def w10(v):
    return W.cumulative_counters(v.fills, ["symbol"], ["time_ns", "event_id"]).select("event_id", "total_trades", "total_volume")


@query("t01_order_by", "SELECT fixture_id, season, home_goals FROM matches ORDER BY season ASC NULLS LAST, home_goals DESC, fixture_id")
def t01(v):
    return v.matches.select("fixture_id", "season", "home_goals").orderBy(F.asc_nulls_last("season"), F.desc("home_goals"), "fixture_id")


@query("t02_top_n", "SELECT player_id, season, goals FROM player_season ORDER BY goals DESC NULLS LAST, player_id * 10000 + season LIMIT 20")
def t02(v):
    return W.top_n(v.player_season.withColumn("k", c("player_id") * 10000 + c("season")), 20, "goals", "k").select("player_id", "season", "goals")


@query("t03_top_filtered", "SELECT player_id, season, rating FROM player_season WHERE appearances > 5 ORDER BY rating DESC NULLS LAST, player_id * 10000 + season LIMIT 10")
def t03(v):
    kept = v.player_season.filter("appearances > 5").withColumn("k", c("player_id") * 10000 + c("season"))
    return W.top_n(kept, 10, "rating", "k").select("player_id", "season", "rating")


@query("t04_best_value", f"WITH {HISTORY_SQL}, {FORM_SQL} SELECT fixture_id, team_id, coalesce(max(round_even(goals, 2)), 0) AS top_scorer FROM form GROUP BY fixture_id, team_id")
def t04(v):
    out = A.player_summaries(form(v), ["goals"])
    return out.select("fixture_id", "team_id", F.coalesce(F.array_max(F.transform("player_summaries", lambda p: p["goals"])), lit(0.0)).alias("top_scorer"))


@query("u01_append_all", "SELECT team_id, team_name, NULL::BIGINT AS age FROM teams UNION ALL SELECT team_id, NULL, age FROM squads")
def u01(v):
    return J.append_all(v.teams.select("team_id", "team_name"), v.squads.select("team_id", "age"))


@query("u02_shared_teams", "SELECT home_team_name AS team FROM matches WHERE season = 1996 INTERSECT SELECT away_team_name FROM matches WHERE season = 1997")
def u02(v):
    return J.shared_teams(v.matches.filter("season = 1996").select(c("home_team_name").alias("team")), v.matches.filter("season = 1997").select("away_team_name"))


@query("u03_only_in_left", "SELECT player_id FROM squads EXCEPT SELECT player_id FROM lineups WHERE is_starter")
def u03(v):
    return J.only_in_left(v.squads.select("player_id"), v.lineups.filter("is_starter").select("player_id"))


@query("u04_teams_of_season", "SELECT season, home_team_name AS team FROM matches UNION SELECT season, away_team_name FROM matches")
def u04(v):
    return J.teams_of_season(v.matches)


@query("u05_named_and_anonymised", "SELECT fixture_id, anonymized FROM matches CROSS JOIN (SELECT unnest([false, true]) AS anonymized)")
def u05(v):
    return J.named_and_anonymised(v.matches.select("fixture_id"))


@query("x01_sum_or_null", "SELECT player_id, season, sum(assists) AS assists FROM player_season_raw WHERE league_id IS NULL GROUP BY player_id, season")
def x01(v):
    return v.player_season_raw.filter("league_id is null").groupBy("player_id", "season").agg(A.sum_or_null("assists").alias("assists"))


