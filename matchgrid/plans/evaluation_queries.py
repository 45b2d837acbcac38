"""Queries E1-E14, B1-B7, W4 and W5."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrid.functions import scalars as S
from matchgrid.operators import evaluation as E
from matchgrid.operators import joins as J
from matchgrid.operators import projections as P
from matchgrid.operators import windows as W
from matchgrid.operators.ranges import LOG_UNITS, RUIN, from_log_units
from matchgrid.plans.projection_queries import FLAGS_SQL, WILSON_SQL
from matchgrid.plans import text_queries
from matchgrid.plans.registry import query
from matchgrid.streaming.streams import shared_folder

c, lit = F.col, F.lit

FLAGS = f"fl AS (SELECT * , CASE WHEN pred_total <= 0 THEN 0.0::DOUBLE ELSE least(greatest(1.0::DOUBLE - (exp(-pred_total::DOUBLE) + exp(-pred_total::DOUBLE) * pred_total + exp(-pred_total::DOUBLE) * pred_total / 1.0::DOUBLE * pred_total / 2.0::DOUBLE), 0), 1) END AS p_over FROM ({FLAGS_SQL}))"
MAE = "avg((abs(pred_home - gt_home) + abs(pred_away - gt_away)) / 2.0::DOUBLE)"


def flags(v):
    return P.derive_prediction_flags(v.predictions)


def with_p(v):
    return flags(v).withColumn("p_over", S.p_over(c("pred_total").cast("double")))


def r9(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


def bin_sql(p, bins):
    w = 1.0 / bins
    whens = [f"WHEN {p} >= {i * w!r}::DOUBLE AND {p} {'<=' if i == bins - 1 else '<'} {(1.0 if i == bins - 1 else (i + 1) * w)!r}::DOUBLE THEN {i}" for i in range(bins)]
    return f"(CASE {' '.join(whens)} END)::INTEGER"


ECE_SQL = f"ec AS (SELECT regime, sum(CASE WHEN bin IS NULL THEN 0 ELSE n * abs(acc - conf) END) / sum(n) AS ece FROM (SELECT regime, {bin_sql('p_over', 10)} AS bin, count(*) AS n, avg(p_over) AS conf, avg(gt_over::INTEGER) AS acc FROM fl GROUP BY ALL) GROUP BY regime)"


@query(
    "e01_regime_summary",
    f"WITH {FLAGS}, {ECE_SQL} SELECT fl.regime, count(*) AS n, round(avg(correct_result::INTEGER), 9) AS result_accuracy, round(avg(correct_score::INTEGER), 9) AS exact_score, round({MAE}, 9) AS goal_mae, "
    "round(avg(correct_direction::INTEGER), 9) AS ou_accuracy, round(avg(pow(p_over - gt_over::INTEGER, 2)), 9) AS brier, round(any_value(ece), 9) AS ece FROM fl JOIN ec ON fl.regime = ec.regime GROUP BY fl.regime",
)
def e01(v):
    return r9(E.regime_summary(flags(v)), "result_accuracy", "exact_score", "goal_mae", "ou_accuracy", "brier", "ece")


@query("e02_goal_mae", f"SELECT regime, round({MAE}, 9) AS goal_mae FROM predictions GROUP BY regime")
def e02(v):
    return r9(v.predictions.groupBy("regime").agg(E.goal_mae().alias("goal_mae")), "goal_mae")


@query("e03_brier", f"WITH {FLAGS} SELECT regime, anonymized, round(avg(pow(p_over - gt_over::INTEGER, 2)), 9) AS brier FROM fl GROUP BY ALL")
def e03(v):
    return r9(with_p(v).groupBy("regime", "anonymized").agg(E.brier(c("p_over"), c("gt_over")).alias("brier")), "brier")


@query("e04_ece", f"WITH {FLAGS}, {ECE_SQL} SELECT regime, round(ece, 9) AS ece FROM ec")
def e04(v):
    return r9(E.ece(with_p(v), ["regime"], "p_over", "gt_over"), "ece")


@query("e05_reliability", f"WITH {FLAGS} SELECT regime, {bin_sql('p_over', 5)} AS bin, round(avg(p_over), 9) AS mean_p, round(avg(gt_over::INTEGER), 9) AS frequency, count(*) AS n FROM fl GROUP BY ALL")
def e05(v):
    return r9(E.reliability(with_p(v), ["regime"], "p_over", "gt_over"), "mean_p", "frequency")


@query(
    "e06_wilson_table",
    f"WITH {FLAGS}, s AS (SELECT regime, 'all' AS subset, correct_result FROM fl UNION ALL SELECT regime, 'named', correct_result FROM fl WHERE NOT anonymized) "
    f"SELECT regime, subset, s::BIGINT AS hits, n::BIGINT AS n, {WILSON_SQL} FROM (SELECT regime, subset, count(*) FILTER (correct_result)::DOUBLE AS s, count(*)::DOUBLE AS n, 1.959963984540054::DOUBLE AS z FROM s GROUP BY ALL)",
)
def e06(v):
    return r9(E.wilson_table(flags(v)), "rate", "low", "high")


@query(
    "e07_mcnemar",
    f"WITH {FLAGS}, d AS (SELECT m.season, count(*) FILTER (a.correct_result AND NOT b.correct_result) AS b, count(*) FILTER (b.correct_result AND NOT a.correct_result) AS c FROM fl a JOIN fl b ON a.fixture_id = b.fixture_id AND a.anonymized = b.anonymized AND a.regime = 'pregame' AND b.regime = 'halftime' "
    "JOIN matches m ON m.fixture_id = a.fixture_id GROUP BY m.season) SELECT season, b, c, CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(0, least(b, c) + 1) t(i))), 6) END AS p_value FROM d",
)
def e07(v):
    f = flags(v).select("fixture_id", "anonymized", "regime", c("correct_result").alias("hit"))
    a, b = f.filter("regime = 'pregame'").drop("regime"), f.filter("regime = 'halftime'").drop("regime")
    pairs = J.pair_on_match(a, b, ["fixture_id", "anonymized"], strict=False).join(v.matches.select("fixture_id", "season"), "fixture_id")
    counts = E.contingency(pairs, ["season"], "hit_a", "hit_b").select("season", c("a_only").alias("b"), c("b_only").alias("c"))
    return counts.withColumn("p_value", F.round(E.mcnemar_p(c("b"), c("c")), 6))


PAIRS_SQL = (
    "pr AS (SELECT a.regime AS regime_a, b.regime AS regime_b, m.metric, CASE m.metric WHEN 'result' THEN a.correct_result WHEN 'score' THEN a.correct_score ELSE a.correct_direction END AS x, "
    "CASE m.metric WHEN 'result' THEN b.correct_result WHEN 'score' THEN b.correct_score ELSE b.correct_direction END AS y FROM fl a JOIN fl b ON a.fixture_id = b.fixture_id AND a.anonymized = b.anonymized AND a.regime < b.regime "
    "CROSS JOIN (SELECT unnest(['result', 'score', 'over_under']) AS metric) m)"
)


@query(
    "e08_mcnemar_table",
    f"WITH {FLAGS}, {PAIRS_SQL}, ct AS (SELECT regime_a, regime_b, metric, count(*) FILTER (x AND y) AS both, count(*) FILTER (x AND NOT y) AS a_only, count(*) FILTER (NOT x AND y) AS b_only, count(*) FILTER (NOT x AND NOT y) AS neither FROM pr GROUP BY ALL) "
    "SELECT ct.*, CASE WHEN a_only + b_only = 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2))) FROM range(0, least(a_only, b_only) + 1) t(i))), 6) END AS p_value FROM ct",
)
def e08(v):
    return E.mcnemar_table(flags(v)).withColumn("p_value", F.round("p_value", 6))


@query("e09_contingency", f"WITH {FLAGS}, {PAIRS_SQL} SELECT metric, count(*) FILTER (x AND y) AS both, count(*) FILTER (x AND NOT y) AS a_only, count(*) FILTER (NOT x AND y) AS b_only, count(*) FILTER (NOT x AND NOT y) AS neither FROM pr GROUP BY metric")
def e09(v):
    return E.contingency(E.regime_pairs(flags(v)), ["metric"], "hit_a", "hit_b")


@query(
    "e10_per_match_error",
    "SELECT a.fixture_id, (abs(a.pred_home - a.gt_home) + abs(a.pred_away - a.gt_away)) / 2.0::DOUBLE AS error_a, (abs(b.pred_home - b.gt_home) + abs(b.pred_away - b.gt_away)) / 2.0::DOUBLE AS error_b "
    "FROM predictions a JOIN predictions b ON a.fixture_id = b.fixture_id AND a.regime = 'pregame' AND b.regime = 'halftime' AND NOT a.anonymized AND NOT b.anonymized",
)
def e10(v):
    error = (F.abs(c("pred_home") - c("gt_home")) + F.abs(c("pred_away") - c("gt_away"))) / 2.0
    p = v.predictions.filter("not anonymized").select("fixture_id", "regime", error.alias("error"))
    return J.pair_on_match(p.filter("regime = 'pregame'").drop("regime"), p.filter("regime = 'halftime'").drop("regime"), ["fixture_id"], strict=False)


@query("e11_named_vs_anonymous", f"WITH {FLAGS} SELECT regime, anonymized, count(*) AS n, round(avg(correct_result::INTEGER), 9) AS accuracy, round(avg(correct_score::INTEGER), 9) AS exact, round({MAE}, 9) AS goal_mae FROM fl GROUP BY ALL")
def e11(v):
    out = flags(v).groupBy("regime", "anonymized").agg(F.count("*").alias("n"), E.share("correct_result").alias("accuracy"), E.share("correct_score").alias("exact"), E.goal_mae().alias("goal_mae"))
    return r9(out, "accuracy", "exact", "goal_mae")


@query("e12_model_comparison")
def e12(v):
    """Both models on the matches that the tabular one was not fitted on, the named ones. The tabular
    rows come from fitted trees, so there is no SQL; tests repeat it in SQL over the saved table."""
    return comparison(v, text_queries.saved_tabular(v, shared_folder(v.spark, "tabular")))


def comparison(v, tabular):
    return r9(E.model_comparison(v.predictions.filter("not anonymized"), tabular), "accuracy", "exact_score", "goal_mae", "ou_accuracy")


@query(
    "e14_baselines",
    f"""WITH m AS (SELECT fixture_id, home_goals AS gt_home, away_goals AS gt_away, ('0x' || substr(md5('42:' || fixture_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM matches),
b AS (SELECT *, 'home' AS strategy, 1 AS pred_home, 0 AS pred_away FROM m UNION ALL SELECT *, 'draw', 1, 1 FROM m UNION ALL SELECT *, 'random', CASE WHEN u < 0.75 THEN 1 ELSE 0 END, CASE WHEN u < 0.4 THEN 0 ELSE 1 END FROM m)
SELECT strategy, round(avg((sign(gt_home - gt_away) = sign(pred_home - pred_away))::INTEGER), 9) AS accuracy, round({MAE}, 9) AS goal_mae FROM b GROUP BY strategy""",
)
def e14(v):
    m = v.matches.select("fixture_id", c("home_goals").alias("gt_home"), c("away_goals").alias("gt_away"))
    parts = [E.baseline(m, s).withColumn("strategy", lit(s)) for s in ("home", "draw", "random")]
    hit = S.result_from_score(c("gt_home"), c("gt_away")) == S.result_from_score(c("pred_home"), c("pred_away"))
    return r9(parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("strategy").agg(F.avg(hit.cast("int")).alias("accuracy"), E.goal_mae().alias("goal_mae")), "accuracy", "goal_mae")


INPUTS_SQL = f"{FLAGS}, bi AS (SELECT regime, fixture_id, p_over, gt_total AS total FROM fl WHERE NOT anonymized)"


def bets_sql(part="0.25::DOUBLE", cap="0.1::DOUBLE", source="bi", over_odds=1.9, under_odds=1.9):
    over = f"(p_over - 1 / {over_odds}::DOUBLE)"
    under = f"((1 - p_over) - 1 / {under_odds}::DOUBLE)"
    chance = f"(CASE WHEN {over} >= {under} THEN p_over ELSE 1 - p_over END)"
    net = f"(CASE WHEN {over} >= {under} THEN {over_odds - 1.0!r}::DOUBLE ELSE {under_odds - 1.0!r}::DOUBLE END)"
    stake = f"least({part} * greatest(({net} * {chance} - (1 - {chance})) / {net}, 0), {cap})"
    return (
        f"bt AS (SELECT *, CASE WHEN NOT placed THEN 0 WHEN won THEN stake * net ELSE -stake END AS bet_return FROM (SELECT *, greatest({over}, {under}) >= 0.05 AND {stake} > 0 AS placed, ({over} >= {under}) = (total > 2.5) AS won, {over} >= {under} AS backs_over, {net} AS net, "
        f"CASE WHEN greatest({over}, {under}) >= 0.05 THEN {stake} ELSE 0 END AS stake FROM {source}))"
    )


def inputs(v):
    return with_p(v).filter("not anonymized").select("regime", "fixture_id", "p_over", c("gt_total").alias("total"))


@query("b01_backtest_inputs", f"WITH {INPUTS_SQL} SELECT regime, fixture_id, round(p_over, 9) AS p_over, total FROM bi")
def b01(v):
    return r9(inputs(v), "p_over").orderBy("regime", "fixture_id")


@query("b02_place_bets", f"WITH {INPUTS_SQL}, {bets_sql()} SELECT regime, fixture_id, CASE WHEN placed THEN CASE WHEN backs_over THEN 'over' ELSE 'under' END END AS side, round(stake, 9) AS stake, round(bet_return, 9) AS bet_return FROM bt")
def b02(v):
    return r9(E.place_bets(inputs(v)).select("regime", "fixture_id", "side", "stake", "bet_return"), "stake", "bet_return")


@query(
    "b02_place_bets_two_odds",
    f"WITH {INPUTS_SQL}, {bets_sql(over_odds=1.8, under_odds=2.1)} SELECT regime, fixture_id, CASE WHEN placed THEN CASE WHEN backs_over THEN 'over' ELSE 'under' END END AS side, round(stake, 9) AS stake, round(bet_return, 9) AS bet_return FROM bt",
)
def b02_two_odds(v):
    return r9(E.place_bets(inputs(v), 1.8, 2.1).select("regime", "fixture_id", "side", "stake", "bet_return"), "stake", "bet_return")


# Paths are compared on hundreds of bets each, by team, so that products stay within doubles.
KEYED_SQL = f"{INPUTS_SQL}, bk AS (SELECT bi.*, m.home_team_id AS team FROM bi JOIN matches m ON bi.fixture_id = m.fixture_id), {bets_sql(source='bk')}"
PATH_SQL = f"{KEYED_SQL}, pa AS (SELECT *, 1000.0::DOUBLE * product(1 + bet_return) OVER w AS bankroll FROM bt WINDOW w AS (PARTITION BY regime, team ORDER BY fixture_id ROWS UNBOUNDED PRECEDING)), pk AS (SELECT *, greatest(max(bankroll) OVER w, 1000) AS peak FROM pa WINDOW w AS (PARTITION BY regime, team ORDER BY fixture_id ROWS UNBOUNDED PRECEDING)), dd AS (SELECT *, (bankroll - peak) / peak AS drawdown FROM pk)"


def keyed(v):
    return inputs(v).join(v.matches.select("fixture_id", c("home_team_id").alias("team")), "fixture_id")


def path(v):
    return E.bankroll_path(E.place_bets(keyed(v)), ["regime", "team"], ["fixture_id"])


# Of thousands of bets the products leave what doubles hold, and their last digits follow the order of
# multiplication. So paths are sums of log10 in whole units of 1e-14 where they are shown.
LOG_PATH_SQL = (
    ", gn AS (SELECT *, CAST(round(log10(1 + bet_return) * 1e14::DOUBLE) AS BIGINT) AS units FROM bt), pa AS (SELECT *, 300000000000000 + sum(units) OVER w AS log_units FROM gn WINDOW w AS (PARTITION BY {0} ORDER BY fixture_id ROWS UNBOUNDED PRECEDING)), "
    "pk AS (SELECT *, greatest(max(log_units) OVER w, 300000000000000) AS peak_units FROM pa WINDOW w AS (PARTITION BY {0} ORDER BY fixture_id ROWS UNBOUNDED PRECEDING)), dd AS (SELECT *, pow(10.0::DOUBLE, (log_units - peak_units)::DOUBLE / 1e14::DOUBLE) - 1 AS drawdown FROM pk)"
)
LOGS_SQL = KEYED_SQL + LOG_PATH_SQL.format("regime, team")


def log_sci_sql(units):
    """'%.6e' of a number given by its log10 in units of 1e-14."""
    power = f"floor({units} / 1e14::DOUBLE)::BIGINT"
    power = f"({power} - CASE WHEN {power} * 100000000000000::HUGEINT > {units} THEN 1 ELSE 0 END)"
    digits = f"round(pow(10.0::DOUBLE, ({units} - {power} * 100000000000000::HUGEINT)::DOUBLE / 1e14::DOUBLE) * 1e6::DOUBLE)::BIGINT"
    return f"(SELECT printf('%d.%06de%s%02d', d // 1000000, d % 1000000, CASE WHEN e < 0 THEN '-' ELSE '+' END, abs(e)) FROM (SELECT CASE WHEN d = 10000000 THEN 1000000 ELSE d END AS d, CASE WHEN d = 10000000 THEN e + 1 ELSE e END AS e FROM (SELECT {digits} AS d, {power} AS e)))"


def log_sci(units):
    """'%.6e' of a number given by its log10 in units of LOG_UNITS."""
    one = lit(LOG_UNITS).cast("decimal(18,0)")
    rest = F.pmod(units, one)
    power = ((units - rest) / one).cast("long")
    digits = F.round(from_log_units(rest) * 1e6).cast("long")
    carried = digits == 10_000_000
    digits, power = F.when(carried, 1_000_000).otherwise(digits), F.when(carried, power + 1).otherwise(power)
    return F.when(units > RUIN / 2, F.format_string("%d.%06de%s%02d", F.floor(digits / 1_000_000), digits % 1_000_000, F.when(power < 0, "-").otherwise("+"), F.abs(power))).otherwise("0.000000e+00")


SHORT = "printf('%.6e', {})"


def sci(x):
    return F.format_string("%.6e", x)


@query(
    "b03_bankroll_path",
    f"WITH {LOGS_SQL} SELECT regime, team, fixture_id, {log_sci_sql('log_units')} AS bankroll, round(drawdown, 6) AS drawdown FROM dd UNION ALL SELECT DISTINCT regime, team, NULL, {SHORT.format('1000.0::DOUBLE')}, 0.0::DOUBLE FROM dd",
)
def b03(v):
    return E.with_start(path(v), ["regime", "team"]).select("regime", "team", "fixture_id", log_sci(c("log_units")).alias("bankroll"), F.round("drawdown", 6).alias("drawdown"))


@query("w04_running_bankroll", f"WITH {LOGS_SQL} SELECT regime, team, fixture_id, {log_sci_sql('log_units')} AS bankroll FROM pa")
def w04(v):
    bets = E.place_bets(keyed(v))
    return W.running_log_product(bets, ["regime", "team"], ["fixture_id"], lit(1.0) + c("bet_return"), "log_units", 1000.0).select("regime", "team", "fixture_id", log_sci(c("log_units")).alias("bankroll"))


@query("w05_drawdown", f"WITH {PATH_SQL} SELECT regime, team, fixture_id, {SHORT.format('peak')} AS running_peak, round(drawdown, 6) AS drawdown FROM dd")
def w05(v):
    bets = W.running_product(E.place_bets(keyed(v)), ["regime", "team"], ["fixture_id"], lit(1.0) + c("bet_return"), "bankroll", 1000.0)
    out = W.drawdown(bets, ["regime", "team"], ["fixture_id"], "bankroll", 1000.0)
    return out.select("regime", "team", "fixture_id", sci("running_peak").alias("running_peak"), F.round("drawdown", 6).alias("drawdown"))


SUMMARY_SQL = f"arg_max(log_units, fixture_id) AS final, round(coalesce(avg(won::INTEGER) FILTER (placed), 0), 9) AS win_rate, round(least(min(drawdown), 0), 6) AS max_drawdown, round(coalesce(avg(bet_return) FILTER (placed) / nullif(stddev_samp(bet_return) FILTER (placed), 0), 0), 6) AS sharpe, count(*) FILTER (placed) AS bets, count(*) FILTER (NOT placed) AS skipped"


def summary(df, keys):
    out = E.backtest_summary(df, keys, ["fixture_id"])
    return out.select(*keys, log_sci(c("final_log_units")).alias("final"), F.round("win_rate", 9).alias("win_rate"), F.round("max_drawdown", 6).alias("max_drawdown"), F.round("sharpe", 6).alias("sharpe"), "bets", "skipped")


@query("b04_backtest_summary", f"WITH {LOGS_SQL} SELECT * REPLACE ({log_sci_sql('final')} AS final) FROM (SELECT regime, team, {SUMMARY_SQL} FROM dd GROUP BY regime, team)")
def b04(v):
    return summary(path(v), ["regime", "team"])


GRID_BETS_SQL = (
    f"{INPUTS_SQL}, bg AS (SELECT bi.*, m.home_team_id AS team, kelly_fraction, cap FROM bi JOIN matches m ON bi.fixture_id = m.fixture_id CROSS JOIN (SELECT unnest([0.1, 0.25, 0.5])::DOUBLE AS kelly_fraction) CROSS JOIN (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS cap) WHERE bi.regime = 'halftime'), "
    + bets_sql("kelly_fraction", "cap", "bg")
)
GRID_SQL = (
    GRID_BETS_SQL
    + ", pa AS (SELECT *, 1000.0::DOUBLE * product(1 + bet_return) OVER w AS bankroll FROM bt WINDOW w AS (PARTITION BY team, kelly_fraction, cap ORDER BY fixture_id ROWS UNBOUNDED PRECEDING)), pk AS (SELECT *, greatest(max(bankroll) OVER w, 1000) AS peak FROM pa WINDOW w AS (PARTITION BY team, kelly_fraction, cap ORDER BY fixture_id ROWS UNBOUNDED PRECEDING)), dd AS (SELECT *, (bankroll - peak) / peak AS drawdown FROM pk)"
)
GRID_KEYS = ["team", "kelly_fraction", "cap"]


def grid_path(v):
    rows = J.config_grid(keyed(v).filter("regime = 'halftime'"), [0.1, 0.25, 0.5], [0.05, 0.1, 0.2])
    return E.bankroll_path(E.place_bets(rows, kelly_fraction=c("kelly_fraction"), cap=c("cap")), GRID_KEYS, ["fixture_id"])


@query("b05_sensitivity_grid", f"WITH {GRID_BETS_SQL}{LOG_PATH_SQL.format('team, kelly_fraction, cap')} SELECT * REPLACE ({log_sci_sql('final')} AS final) FROM (SELECT team, kelly_fraction, cap, {SUMMARY_SQL} FROM dd GROUP BY ALL)")
def b05(v):
    return summary(grid_path(v), GRID_KEYS)


@query(
    "b06_pivot_grid",
    f"WITH {GRID_SQL} SELECT kelly_fraction, count(DISTINCT fixture_id) FILTER (cap = 0.05 AND placed) AS cap_5, count(DISTINCT fixture_id) FILTER (cap = 0.1 AND placed) AS cap_10, count(DISTINCT fixture_id) FILTER (cap = 0.2 AND placed) AS cap_20 FROM dd GROUP BY kelly_fraction",
)
def b06(v):
    counts = grid_path(v).filter("stake > 0").groupBy("kelly_fraction").pivot("cap", [0.05, 0.1, 0.2]).agg(F.count(lit(1)))
    return counts.toDF("kelly_fraction", "cap_5", "cap_10", "cap_20")


@query("b07_bootstrap")
def b07(v):
    """All placed bets and 10,000 trials; drawn at random, so tests compare it with plain resampling."""
    return E.bootstrap(E.place_bets(keyed(v)), ["regime", "team"])
