"""Queries G1-G11, E13, M1-M5."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from matchgrid.functions import scalars as S
from matchgrid.operators import joins as J
from matchgrid.operators import model as M
from matchgrid.operators import projections as P
from matchgrid.operators import text as G
from matchgrid.operators.lineage import checkpointed
from matchgrid.plans import relational_queries as R
from matchgrid.plans.registry import query

c, lit = F.col, F.lit

BLOCK_SQL = f"""{R.CHAIN_SQL}, po AS (SELECT fixture_id, team_id, string_agg(n || ' ' || upper(left(pos, 3)), ', ' ORDER BY CASE pos WHEN 'Goalkeeper' THEN 1 WHEN 'Defender' THEN 2 WHEN 'Midfielder' THEN 3 WHEN 'Attacker' THEN 4 WHEN 'Forward' THEN 5 ELSE 99 END, pos) AS positions
  FROM (SELECT fixture_id, team_id, coalesce(position, form_position, 'Unknown') AS pos, count(*) AS n FROM form GROUP BY ALL) GROUP BY ALL),
tp AS (SELECT fixture_id, team_id, coalesce(max(round_even(goals, 2)), 0) AS top_scorer FROM form GROUP BY ALL),
stf AS (SELECT fixture_id, team_id, arg_min(coach, (number, player_id)) AS coach, any_value(formation) AS formation FROM lineups WHERE is_starter GROUP BY ALL),
bl AS (SELECT prof.*, positions, top_scorer, coach, formation FROM prof JOIN po USING (fixture_id, team_id) JOIN tp USING (fixture_id, team_id) LEFT JOIN stf USING (fixture_id, team_id)),
{R.TEAM_MATCH_SQL},
fm AS (SELECT team_name, season, coalesce(string_agg(t, ', ' ORDER BY past, fx) FILTER (r <= 3), '') AS form FROM (SELECT d.team_name, d.season, p.season AS past, p.fixture_id AS fx, CASE WHEN scored > conceded THEN 'W' WHEN scored < conceded THEN 'L' ELSE 'D' END || ' ' || scored || '-' || conceded AS t,
  CASE WHEN p.fixture_id IS NULL THEN 9 ELSE row_number() OVER (PARTITION BY d.team_name, d.season ORDER BY p.season DESC, p.fixture_id DESC) END AS r FROM (SELECT DISTINCT team_name, season FROM tm) d LEFT JOIN tm p ON d.team_name = p.team_name AND p.season < d.season) GROUP BY ALL),
hh AS ({R.ORACLE_H2H}),
cx AS (SELECT m.*, h AS hp, a AS ap, f1.form AS home_form, f2.form AS away_form, hh.matches AS met, hh.team1_wins, hh.team2_wins, hh.draws, CASE WHEN home_goals > away_goals THEN 'home_win' WHEN home_goals < away_goals THEN 'away_win' ELSE 'draw' END AS result
  FROM matches m LEFT JOIN bl h ON m.fixture_id = h.fixture_id AND m.home_team_id = h.team_id LEFT JOIN bl a ON m.fixture_id = a.fixture_id AND m.away_team_id = a.team_id LEFT JOIN fm f1 ON m.home_team_name = f1.team_name AND m.season = f1.season LEFT JOIN fm f2 ON m.away_team_name = f2.team_name AND m.season = f2.season LEFT JOIN hh ON m.fixture_id = hh.fixture_id)"""


def context(v, shown):
    """Match contexts with the sums and means of these columns, which are all that starters carry through their shuffles."""
    starters = R.form(v, "left", "coach", "formation").select(*R.FORM_KEYS, "coach", "formation", "seasons_with_data", "form_position", *dict.fromkeys(["goals", *shown]))
    return G.match_context(v.matches, starters, G.form_before(R.team_match(v)))


def prompts(v):
    return context(v, G.BLOCK_COLUMNS)


@query(
    "g01_match_context",
    f"{BLOCK_SQL} SELECT fixture_id, hp.team_total_goals AS home_total_goals, ap.positions AS away_positions, hp.coach AS home_coach, home_form, away_form, met, team1_wins, result FROM cx",
)
def g01(v):
    return context(v, ["goals"]).select(
        "fixture_id", c("home_profile.team_total_goals").alias("home_total_goals"), c("away_profile.positions").alias("away_positions"), c("home_profile.coach").alias("home_coach"), "home_form", "away_form", c("h2h.matches").alias("met"), c("h2h.team1_wins").alias("team1_wins"), "result"
    )


def fmt(x, d):
    shown = f"round_even({x}, 0)::BIGINT::VARCHAR" if d == 0 else f"printf('%.{d}f', round_even({x}, {d}))"
    return f"CASE WHEN {x} IS NULL OR {x} = 0 THEN '-' ELSE {shown} END"


def block_sql(p, label):
    return (
        f"CASE WHEN {p}.num_starters_with_data IS NULL THEN {label} || ': No data' ELSE {label} || ' | Coach: ' || coalesce({p}.coach, '?') || ' | Formation: ' || coalesce({p}.formation, '?') || chr(10) || 'Squad: ' || {p}.num_starters_with_data || ' starters | Avg Rating: ' || {fmt(p + '.team_avg_rating', 1)} || chr(10) || "
        f"'Attack: ' || {fmt(p + '.team_total_goals', 0)} || ' goals (' || {fmt(p + '.team_avg_goals_per_90', 2)} || '/90) | ' || {fmt(p + '.team_total_assists', 0)} || ' assists | Top scorer: ' || CASE WHEN {p}.top_scorer > 0 THEN trunc({p}.top_scorer)::BIGINT::VARCHAR ELSE '-' END || ' goals' || chr(10) || "
        f"'Defense: ' || {fmt(p + '.team_total_cards_yellow', 0)} || ' yellows, ' || {fmt(p + '.team_total_cards_red', 0)} || ' reds | Tackles/90: ' || {fmt(p + '.team_avg_tackles_per_90', 2)} || ' | Duels: ' || {fmt(p + '.team_avg_duel_win_pct', 0)} || '%' || chr(10) || "
        f"'Passing: ' || {fmt(p + '.team_avg_passes_accuracy', 0)} || '% accuracy' || chr(10) || 'Positions: ' || {p}.positions END"
    )


def form_sql(x):
    return f"CASE WHEN coalesce({x}, '') = '' THEN 'No prior WC data' ELSE 'WC Form: ' || {x} END"


H2H_SQL = "CASE WHEN coalesce(met, 0) = 0 THEN 'H2H: No prior meetings' ELSE 'H2H (' || met || ' games): ' || home_team_name || ' ' || team1_wins || 'W, ' || away_team_name || ' ' || team2_wins || 'W, ' || draws || 'D' END"


@query("g02_team_block", f"{BLOCK_SQL} SELECT fixture_id, {block_sql('hp', 'home_team_name')} AS block FROM cx")
def g02(v):
    return prompts(v).select("fixture_id", F.concat("home_team_name", F.get("blocks", lit(0))).alias("block"))


@query("g03_form_and_h2h", f"{BLOCK_SQL} SELECT fixture_id, {form_sql('home_form')} AS form, {H2H_SQL} AS h2h FROM cx")
def g03(v):
    return context(v, []).select("fixture_id", G.render_form(c("home_form")).alias("form"), G.render_h2h(c("h2h"), c("home_team_name"), c("away_team_name")).alias("h2h"))


def user_sql(hidden):
    home, away = ("'Team A'", "'Team B'") if hidden else ("home_team_name", "away_team_name")
    h2h = "'H2H: Hidden (anonymized)'" if hidden else H2H_SQL
    nl, gap = "chr(10)", "chr(10) || chr(10)"
    return (
        f"'World Cup ' || season || ' | ' || coalesce(round, 'None') || ' | ' || coalesce(venue, 'Unknown') || {gap} || {block_sql('hp', home + " || ' (Home)'")} || {nl} || {form_sql('home_form')} || {gap} || {block_sql('ap', away + " || ' (Away)'")} || {nl} || {form_sql('away_form')} || {gap} || {h2h} || {gap} || 'Predict result, score, and reasoning.'"
    )


@query("g04_user_message", f"{BLOCK_SQL} SELECT fixture_id, false AS anonymized, {user_sql(False)} AS message FROM cx UNION ALL SELECT fixture_id, true, {user_sql(True)} FROM cx")
def g04(v):
    return J.named_and_anonymised(prompts(v)).select("fixture_id", "anonymized", G.render_user_message(c("anonymized")).alias("message"))


def reasoning_sql(home="home_team_name", away="away_team_name"):
    z = lambda p, n: f"coalesce({p}.{n}, 0)"
    hg, ag, hr, ar, ht, at, hp, ap = z("hp", "team_total_goals"), z("ap", "team_total_goals"), z("hp", "team_avg_rating"), z("ap", "team_avg_rating"), z("hp", "top_scorer"), z("ap", "top_scorer"), z("hp", "team_avg_passes_accuracy"), z("ap", "team_avg_passes_accuracy")
    w = lambda x: f"trunc({x})::BIGINT"
    goals = f"CASE WHEN {hg} > 0 AND {ag} > 0 AND {hg} > {ag} * 1.15::DOUBLE THEN {home} || '''s squad has higher goal output (' || {w(hg)} || ' vs ' || {w(ag)} || ')' WHEN {hg} > 0 AND {ag} > 0 AND {ag} > {hg} * 1.15::DOUBLE THEN {away} || '''s squad has higher goal output (' || {w(ag)} || ' vs ' || {w(hg)} || ')' END"
    one = lambda x: f"printf('%.1f', round_even({x}, 1))"
    rating = f"CASE WHEN {hr} > 0 AND {ar} > 0 AND abs({hr} - {ar}) > 0.15::DOUBLE THEN CASE WHEN {hr} > {ar} THEN {home} ELSE {away} END || ' has a higher average rating (' || {one(f'greatest({hr}, {ar})')} || ' vs ' || {one(f'least({hr}, {ar})')} || ')' END"
    top = f"CASE WHEN {ht} > 0 AND {at} > 0 AND abs({ht} - {at}) > 5 THEN CASE WHEN {ht} > {at} THEN {home} ELSE {away} END || '''s top scorer is more prolific (' || {w(f'greatest({ht}, {at})')} || ' vs ' || {w(f'least({ht}, {at})')} || ' goals)' END"
    none = lambda x: f"round_even({x}, 0)::BIGINT"
    passing = f"CASE WHEN {hp} > 0 AND {ap} > 0 AND abs({hp} - {ap}) > 3 THEN CASE WHEN {hp} > {ap} THEN {home} ELSE {away} END || ' has better passing (' || {none(f'greatest({hp}, {ap})')} || '% vs ' || {none(f'least({hp}, {ap})')} || '%)' END"
    default = f"CASE result WHEN 'draw' THEN 'Both teams have closely matched statistical profiles suggesting an even contest' WHEN 'home_win' THEN {home} || '''s overall squad quality and form give them the edge' ELSE {away} || '''s overall squad quality and form give them the edge' END"
    return f"coalesce(nullif(array_to_string(list_filter([{goals}, {rating}, {top}, {passing}], lambda x: x IS NOT NULL)[1:3], '. '), ''), {default}) || '.'"


@query("g05_reasoning", f"{BLOCK_SQL} SELECT fixture_id, {reasoning_sql()} AS reasoning FROM cx")
def g05(v):
    return context(v, G.REASONING_COLUMNS).select("fixture_id", G.render_reasoning(lit(False)).alias("reasoning"))


ANSWER = "'Prediction: ' || result || chr(10) || 'Score: ' || home_goals || '-' || away_goals || chr(10) || 'Reasoning: ' || "
TEAMS = ("'Team A'", "'Team B'")


@query(
    "g06_chat_samples",
    f"{BLOCK_SQL}, sm AS (SELECT fixture_id, false AS anonymized, {user_sql(False)} AS u, {ANSWER}{reasoning_sql()} AS a FROM cx UNION ALL SELECT fixture_id, true, {user_sql(True)}, {ANSWER}{reasoning_sql(*TEAMS)} FROM cx) "
    f"SELECT fixture_id, anonymized, 'system' AS role, '{G.SYSTEM_PROMPT}' AS content FROM sm UNION ALL SELECT fixture_id, anonymized, 'user', u FROM sm UNION ALL SELECT fixture_id, anonymized, 'assistant', a FROM sm",
)
def g06(v):
    # a sample always has messages; explode would have Spark render them all before the shuffle too, to filter by their number
    out = G.chat_samples(prompts(v)).select("metadata.fixture_id", "metadata.anonymized", F.explode_outer("messages").alias("m"))
    return out.select("fixture_id", "anonymized", c("m")["role"].alias("role"), c("m")["content"].alias("content"))


@query(
    "g07_halftime_prompt",
    f"""{BLOCK_SQL}, ev AS (SELECT fixture_id, string_agg(time_elapsed || ''' ' || event_type || ' ' || player_name, '; ' ORDER BY time_elapsed, event_id) AS events FROM match_events WHERE time_elapsed BETWEEN 0 AND 45 AND event_type IN ('Goal', 'Card') GROUP BY fixture_id)
SELECT cx.fixture_id, regexp_replace(replace({user_sql(False)}, 'Predict result, score, and reasoning.', ''), '\\s+$', '') || chr(10) || chr(10) || 'Halftime Score: ' || home_team_name || ' ' || halftime_home || ' - ' || halftime_away || ' ' || away_team_name || chr(10) || chr(10) || 'Given the halftime state, predict the FINAL result, FINAL score, and brief reasoning.' AS prompt,
coalesce(events, '') AS events FROM cx LEFT JOIN ev ON cx.fixture_id = ev.fixture_id WHERE halftime_home IS NOT NULL""",
)
def g07(v):
    prompt = G.halftime_prompt(G.render_user_message(lit(False)), c("home_team_name"), c("away_team_name"), c("halftime_home"), c("halftime_away"))
    out = prompts(v).filter("halftime_home is not null").select("fixture_id", prompt.alias("prompt"))
    return out.join(G.events_text(P.first_half_events(v.match_events)), "fixture_id", "left").withColumn("events", F.coalesce("events", lit("")))


def result_sql(h, a):
    return f"CASE WHEN {h} > {a} THEN 'home_win' WHEN {h} < {a} THEN 'away_win' WHEN {h} = {a} THEN 'draw' END"


PARSED_SQL = r"""ps AS (SELECT *, CASE WHEN sh > sa THEN 'home_win' WHEN sh < sa THEN 'away_win' WHEN sh = sa THEN 'draw' WHEN label LIKE '%draw%' THEN 'draw' WHEN label LIKE '%home%' THEN 'home_win' WHEN label LIKE '%away%' THEN 'away_win' END AS prediction FROM (
SELECT *, CASE WHEN regexp_matches(output, 'Score:\s*(\d+)\s*[-–—]\s*(\d+)') THEN regexp_extract(output, 'Score:\s*(\d+)\s*[-–—]\s*(\d+)', 1)::BIGINT END AS sh, CASE WHEN regexp_matches(output, 'Score:\s*(\d+)\s*[-–—]\s*(\d+)') THEN regexp_extract(output, 'Score:\s*(\d+)\s*[-–—]\s*(\d+)', 2)::BIGINT END AS sa,
CASE WHEN regexp_matches(output, '(?i)Prediction:\s*(.*?)(?:\n|$)') THEN lower(trim(regexp_extract(output, '(?i)Prediction:\s*(.*?)(?:\n|$)', 1))) END AS label, CASE WHEN regexp_matches(output, '(?is)Reasoning:\s*(.*)') THEN regexp_replace(regexp_extract(output, '(?is)Reasoning:\s*(.*)', 1), '^\s+|\s+$', '', 'g') END AS reasoning FROM outputs))"""


@query("g08_parse_outputs", f"WITH {PARSED_SQL} SELECT fixture_id, regime, anonymized, prediction, sh AS parsed_home, sa AS parsed_away, reasoning FROM ps")
def g08(v):
    return G.parse_outputs(v.outputs).select("fixture_id", "regime", "anonymized", "prediction", "parsed_home", "parsed_away", "reasoning")


LOOSE_SQL = r"""lo AS (SELECT *, CASE WHEN lh > la THEN 'home_win' WHEN lh < la THEN 'away_win' WHEN lh = la THEN 'draw' WHEN label LIKE '%draw%' THEN 'draw' WHEN label LIKE '%home%' OR label LIKE '%team a%' THEN 'home_win' WHEN label LIKE '%away%' OR label LIKE '%team b%' THEN 'away_win' WHEN label LIKE '%win%' THEN 'has_winner' END AS prediction FROM (
SELECT *, coalesce(try_cast(nullif(regexp_extract(output, 'score[:\s]+.*?(\d+)\s*[-–]\s*(\d+)', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(output, '(\d+)\s*[-–]\s*(\d+)', 1), '') AS BIGINT)) AS lh,
coalesce(try_cast(nullif(regexp_extract(output, 'score[:\s]+.*?(\d+)\s*[-–]\s*(\d+)', 2), '') AS BIGINT), try_cast(nullif(regexp_extract(output, '(\d+)\s*[-–]\s*(\d+)', 2), '') AS BIGINT)) AS la,
CASE WHEN regexp_matches(lower(output), 'prediction[:\s]+(.*?)(?:\n|$)') THEN trim(regexp_extract(lower(output), 'prediction[:\s]+(.*?)(?:\n|$)', 1)) END AS label FROM outputs))"""


@query("g09_parse_lenient", f"WITH {LOOSE_SQL} SELECT fixture_id, regime, anonymized, prediction, lh AS parsed_home, la AS parsed_away, prediction IS NOT NULL AS parsed FROM lo")
def g09(v):
    return G.parse_outputs_lenient(v.outputs).select("fixture_id", "regime", "anonymized", "prediction", "parsed_home", "parsed_away", "parsed")


@query(
    "g10_attach_p_over",
    f"WITH {PARSED_SQL}, x AS (SELECT fixture_id, regime, anonymized, (sh + sa)::DOUBLE AS x FROM ps) SELECT fixture_id, regime, anonymized, x IS NOT NULL AS parsed, CASE WHEN x <= 0 THEN 0.0::DOUBLE WHEN x IS NOT NULL THEN round(least(greatest(1 - (exp(-x) + exp(-x) * x + exp(-x) * x * x / 2), 0), 1), 9) END AS p_over FROM x",
)
def g10(v):
    total = (c("parsed_home") + c("parsed_away")).cast("double")
    out = G.parse_outputs(v.outputs)
    return out.select("fixture_id", "regime", "anonymized", total.isNotNull().alias("parsed"), F.round(S.p_over(total), 9).alias("p_over"))


@query("g11_split_variant", f"{BLOCK_SQL} SELECT fixture_id, 'named' AS variant FROM cx UNION ALL SELECT fixture_id, 'anonymized' FROM cx")
def g11(v):
    rows = J.named_and_anonymised(prompts(v)).select("fixture_id", G.render_user_message(c("anonymized")).alias("message"))
    return rows.select("fixture_id", G.split_variant(c("message")).alias("variant"))


@query(
    "e13_parse_quality",
    f"WITH {LOOSE_SQL} SELECT regime, count(*) AS total, count(prediction) AS parsed, round(count(prediction)::DOUBLE / count(*), 9) AS parse_rate, round(count(*) FILTER (prediction = gt_result)::DOUBLE / nullif(count(prediction), 0), 9) AS accuracy, "
    "round(avg((abs(lh - gt_home) + abs(la - gt_away)) / 2.0::DOUBLE), 9) AS goal_mae FROM lo GROUP BY regime",
)
def e13(v):
    out = G.parse_outputs_lenient(v.outputs)
    error = (F.abs(c("parsed_home") - c("gt_home")) + F.abs(c("parsed_away") - c("gt_away"))) / 2.0
    out = out.groupBy("regime").agg(F.count("*").alias("total"), F.count_if("parsed").alias("parsed"), F.count_if(c("prediction") == c("gt_result")).alias("right"), F.avg(error).alias("goal_mae"))
    rate = lambda a, b: F.round(F.try_divide(c(a).cast("double"), F.nullif(c(b), lit(0)).cast("double")), 9)
    return out.select("regime", "total", "parsed", rate("parsed", "total").alias("parse_rate"), rate("right", "parsed").alias("accuracy"), F.round("goal_mae", 9).alias("goal_mae"))


# -- features and model ------------------------------------------------------------------------

FEATURE_SQL = f"{R.CHAIN_SQL}, bd AS (SELECT fixture_id, team_id, " + ", ".join(f"count(*) FILTER (coalesce(position, form_position, 'Unknown') = '{p}')::DOUBLE AS pos_{p.lower()}" for p in G.FEATURE_POSITIONS) + " FROM form GROUP BY ALL), tf AS (SELECT prof.fixture_id, prof.team_id, " + ", ".join(f"coalesce({x}, 0)::DOUBLE AS {n}" for n, x in G.TEAM_FEATURES.items()) + ", " + ", ".join(f"pos_{p.lower()}" for p in G.FEATURE_POSITIONS) + " FROM prof JOIN bd USING (fixture_id, team_id))"
NAMES = [*G.TEAM_FEATURES, *[f"pos_{p.lower()}" for p in G.FEATURE_POSITIONS]]


def features(v):
    return G.team_features(R.form(v))


@query("m01_team_features", f"{FEATURE_SQL} SELECT fixture_id, team_id, {', '.join(NAMES)} FROM tf")
def m01(v):
    return features(v)


MATCH_FEATURES_SQL = f"{FEATURE_SQL}, mf AS (SELECT m.*, " + ", ".join(f"coalesce(h.{n}, 0) AS home_{n}, coalesce(a.{n}, 0) AS away_{n}, coalesce(h.{n}, 0) - coalesce(a.{n}, 0) AS diff_{n}" for n in NAMES) + " FROM matches m LEFT JOIN tf h ON m.fixture_id = h.fixture_id AND m.home_team_id = h.team_id LEFT JOIN tf a ON m.fixture_id = a.fixture_id AND m.away_team_id = a.team_id)"
ALL_NAMES = [f"{s}_{n}" for n in NAMES for s in ("home", "away", "diff")]


@query("m02_match_features", f"{MATCH_FEATURES_SQL} SELECT fixture_id, {', '.join(ALL_NAMES)}, coalesce(halftime_home, 0)::DOUBLE AS ht_home, coalesce(halftime_home, 0)::DOUBLE - coalesce(halftime_away, 0) AS ht_diff FROM mf")
def m02(v):
    return G.match_features(v.matches, features(v), "halftime").select("fixture_id", *ALL_NAMES, "ht_home", "ht_diff")


def dataset(v, regime="halftime"):
    rows = P.complete_for_regime(v.matches, regime)
    return G.match_features(rows, features(v), regime).withColumn("label", S.result_from_score(c("home_goals"), c("away_goals")))


@query("m03_build_dataset", f"{MATCH_FEATURES_SQL} SELECT fixture_id, diff_total_goals, {result_sql('home_goals', 'away_goals')} AS label FROM mf WHERE halftime_home IS NOT NULL AND halftime_away IS NOT NULL")
def m03(v):
    return dataset(v).select("fixture_id", "diff_total_goals", "label")


@query("m04_fit_predict")
def m04(v):
    """200 trees of depth 4 at .05 on the seasons before 1999; tests compare the trees with plain ones."""
    return tabular(tabular_data(v), "halftime")


HALFTIME_NAMES = ["ht_home", "ht_away", "ht_total", "ht_diff"]


def tabular_data(v):
    """What the models of both regimes read, made once: their features, labels and the scores that tell which rows a regime has."""
    rows = P.complete_for_regime(v.matches, "pregame")
    data = G.match_features(rows, features(v), "halftime").withColumn("label", S.result_from_score(c("home_goals"), c("away_goals")))
    return checkpointed(data.select("fixture_id", "season", "home_goals", "away_goals", "halftime_home", "halftime_away", "label", *ALL_NAMES, *HALFTIME_NAMES))


def tabular(data, regime):
    """The tabular model of a regime: fitted on the early seasons, its rows of the later ones."""
    data = P.complete_for_regime(data, regime)
    names = [*ALL_NAMES, *(HALFTIME_NAMES if regime == "halftime" else [])]
    return M.tidy_predictions(M.fit_predict(data.filter("season < 1999"), data.filter("season >= 1999"), names))


def saved_tabular(v, folder):
    """The tabular rows of both regimes, written to a table and read from it. The two models are fitted side by side:
    a level is a short job, and what a driver does between two of one model is time for the other's."""
    data = tabular_data(v)
    save = inheritable_thread_target(v.spark)(lambda regime: tabular(data, regime).write.parquet(f"{folder}/regime={regime}"))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(save, ("pregame", "halftime")))
    return v.spark.read.parquet(folder)


@query(
    "m05_decode_predictions",
    "SELECT fixture_id, CASE WHEN a >= b AND a >= d THEN 'home_win' WHEN b >= d THEN 'draw' ELSE 'away_win' END AS pred_result, round_even(greatest(x, 0), 0)::BIGINT AS pred_home, round_even(greatest(y, 0), 0)::BIGINT AS pred_away FROM "
    "(SELECT fixture_id, fixture_id % 7 AS a, fixture_id % 5 AS b, fixture_id % 11 AS d, (fixture_id % 13 - 3) / 2.0::DOUBLE AS x, (fixture_id % 9 - 2) / 2.0::DOUBLE AS y FROM matches)",
)
def m05(v):
    f = c("fixture_id")
    rows = v.matches.select("fixture_id", F.array(f % 7, f % 5, f % 11).alias("s"), ((f % 13 - 3) / 2.0).alias("x"), ((f % 9 - 2) / 2.0).alias("y"))
    return G.decode_predictions(rows, "s", "x", "y").select("fixture_id", "pred_result", "pred_home", "pred_away")


