"""Column derivations and filters. All are pure, row by row, and stay in code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.functions.scalars import half_even, ratio, result_from_score

#: Columns of a player's match that null stands for zero in, once the player appeared.
ZERO_IF_APPEARED = (
    "shots_total", "shots_on_target", "goals_scored", "goals_conceded", "goals_assists", "goals_saves", "passes_total", "passes_key", "passes_accuracy", "tackles_total",
    "tackles_blocks", "tackles_interceptions", "duels_total", "duels_won", "dribbles_attempts", "dribbles_success", "dribbles_past", "fouls_drawn", "fouls_committed",
    "cards_yellow", "cards_red", "penalty_won", "penalty_committed", "penalty_scored", "penalty_missed", "penalty_saved", "offsides",
)


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles; text that is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def derive_player_rates(df: DataFrame) -> DataFrame:
    """Per-90 rates (2 places) and shares (1 place) of a player's season; null on zero denominators."""

    def share(a: Column, b: Column, scale: float, digits: int) -> Column:
        return half_even(F.try_divide(a, F.nullif(b, F.lit(0.0))) * F.lit(scale), digits)

    c, minutes = F.col, F.col("minutes")
    return df.withColumns(
        {
            "goals_per_90": share(c("goals"), minutes, 90.0, 2),
            "assists_per_90": share(c("assists"), minutes, 90.0, 2),
            "goal_contributions_per_90": share(c("goals") + c("assists"), minutes, 90.0, 2),
            "shot_accuracy": share(c("shots_on_target"), c("shots_total"), 100.0, 1),
            "duel_win_pct": share(c("duels_won"), c("duels_total"), 100.0, 1),
            "tackles_per_90": share(c("tackles_total"), minutes, 90.0, 2),
            "dribble_success_pct": share(c("dribbles_success"), c("dribbles_attempts"), 100.0, 1),
        }
    )


def fill_zero_if_appeared(df: DataFrame, columns: Sequence[str] = ZERO_IF_APPEARED, appeared: str = "appeared") -> DataFrame:
    there = F.coalesce(F.col(appeared), F.lit(False))
    return df.withColumns({c: F.when(there, F.coalesce(F.col(c), F.lit(0))).otherwise(F.col(c)) for c in columns if c in df.columns})


def derive_player_match(df: DataFrame) -> DataFrame:
    """Ratios, action sums and per-90 rates of one player's match; null on zero denominators."""
    c = F.col
    out = {
        "pass_accuracy_pct": ratio(c("passes_accuracy"), c("passes_total"), 100, 1),
        "duel_win_pct": ratio(c("duels_won"), c("duels_total"), 100, 1),
        "dribble_success_pct": ratio(c("dribbles_success"), c("dribbles_attempts"), 100, 1),
        "shot_accuracy_pct": ratio(c("shots_on_target"), c("shots_total"), 100, 1),
        "goals_per_shot": ratio(c("goals_scored"), c("shots_total"), 1, 3),
        "minutes_per_goal": ratio(c("minutes_played"), c("goals_scored"), 1, 1),
        "defensive_actions": c("tackles_total") + c("tackles_interceptions") + c("tackles_blocks"),
        "attacking_actions": c("goals_scored") + c("goals_assists") + c("passes_key"),
    }
    per_90 = {
        "goals_scored": "goals_per_90",
        "goals_assists": "assists_per_90",
        "passes_key": "key_passes_per_90",
        "tackles_total": "tackles_per_90",
        "dribbles_success": "successful_dribbles_per_90",
        "fouls_committed": "fouls_committed_per_90",
    }
    return df.withColumns(out | {name: ratio(c(x), c("minutes_played"), 90, 3) for x, name in per_90.items()})


def derive_match_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    h, a = F.col("home_goals"), F.col("away_goals")
    group = F.coalesce(F.lower("round").contains("group"), F.lit(False))
    penalties, extra = F.coalesce("went_to_penalties", F.lit(False)), F.coalesce("went_to_extra_time", F.lit(False))
    return df.withColumns(
        {
            "day_of_week": F.date_format(ts, "EEEE"),
            "match_month": F.month(ts),
            "match_hour": F.hour(ts),
            "is_group_stage": group,
            "is_knockout": ~group,
            "total_goals": h + a,
            "goal_difference": F.abs(h - a),
            "home_goal_diff": h - a,
            "match_result": result_from_score(h, a),
            "decided_by_penalties": penalties,
            "decided_by_extra_time": extra & ~penalties,
            "decided_in_regular_time": ~extra,
            "is_high_scoring": h + a >= 4,
            "is_clean_sheet_home": a == 0,
            "is_clean_sheet_away": h == 0,
        }
    )


def derive_event_features(df: DataFrame) -> DataFrame:
    """Time flags and a bucket. The last two labels are one bucket late, as the data's users expect."""
    t, extra = F.col("time_elapsed"), F.col("time_extra")
    at = F.greatest(t, F.lit(0))
    bucket = F.when(at <= 15, "0-15")
    for upto, label in ((30, "16-30"), (45, "31-45"), (60, "46-60"), (75, "61-75"), (90, "76-90"), (120, "91-105"), (999, "106-120")):
        bucket = bucket.when(at <= upto, label)
    return df.withColumns(
        {
            "time_bucket": F.when(t.isNotNull(), bucket),
            "is_first_half": (t >= 0) & (t <= 45),
            "is_second_half": (t > 45) & (t <= 90),
            "is_extra_time": t > 90,
            "is_injury_time": extra.isNotNull() & (extra > 0),
            "is_late_event": t >= 80,
        }
    )


def derive_team_match(df: DataFrame) -> DataFrame:
    """Ratios and indices of a team's match; 0.0 on zero denominators."""
    c, zero = F.col, F.lit(0.0)
    lost = c("dispossessed") + c("miscontrols")
    df = df.withColumns({"set_piece_passes": c("corners") + c("free_kicks") + c("throw_ins") + c("goal_kicks")})
    return df.withColumns(
        {
            "shot_accuracy": ratio(c("shots_on_target"), c("total_shots"), 100, 1, zero),
            "shot_conversion_rate": ratio(c("goals_scored"), c("total_shots"), 100, 1, zero),
            "xg_per_shot": ratio(c("xg"), c("total_shots"), 1, 4, zero),
            "xg_overperformance": half_even(c("goals_scored") - c("xg"), 4),
            "xg_differential": half_even(c("xg") - c("xg_conceded"), 4),
            "pass_completion_pct": ratio(c("passes_completed"), c("total_passes"), 100, 1, zero),
            "long_pass_completion_pct": ratio(c("long_passes_completed"), c("long_passes"), 100, 1, zero),
            "long_pass_ratio": ratio(c("long_passes"), c("total_passes"), 100, 1, zero),
            "cross_ratio": ratio(c("crosses"), c("total_passes"), 100, 1, zero),
            "tackle_success_rate": ratio(c("tackles_won"), c("tackles"), 100, 1, zero),
            "aerial_win_pct": ratio(c("aerial_duels_won"), c("aerial_duels_total"), 100, 1, zero),
            "defensive_actions": c("tackles") + c("interceptions") + c("clearances") + c("blocks"),
            "pressure_intensity": c("pressures"),
            "recoveries_per_possession_lost": ratio(c("ball_recoveries"), lost, 1, 2, c("ball_recoveries").cast("double")),
            "dribble_success_rate": ratio(c("dribbles_completed"), c("dribbles_attempted"), 100, 1, zero),
            "discipline_index": half_even(c("yellow_cards") + c("red_cards") * 3 + c("fouls_committed") * F.lit(0.1), 2),
            "goal_difference": c("goals_scored") - c("goals_conceded"),
            "match_result": F.when(c("goals_scored") > c("goals_conceded"), "W").when(c("goals_scored") < c("goals_conceded"), "L").otherwise("D"),
            "is_clean_sheet": (c("goals_conceded") == 0).cast("int"),
            "possession_differential": half_even(c("ball_possession_pct") - F.lit(50.0), 1),
            "set_piece_ratio": ratio(c("set_piece_passes"), c("total_passes"), 100, 1, zero),
            "gk_total_actions": c("gk_saves") + c("gk_punches") + c("gk_claims") + c("gk_sweeper"),
        }
    )


def derive_prediction_flags(df: DataFrame, line: float = 2.5) -> DataFrame:
    """Results of both scores, and what the prediction got right."""
    gh, ga, ph, pa = (F.col(x) for x in ("gt_home", "gt_away", "pred_home", "pred_away"))
    df = df.withColumns({"gt_from_score": result_from_score(gh, ga), "pred_from_score": result_from_score(ph, pa), "gt_total": gh + ga, "pred_total": ph + pa})
    df = df.withColumns({"gt_over": F.col("gt_total") > line, "pred_over": F.col("pred_total") > line})
    return df.withColumns(
        {
            "correct_result": F.coalesce(F.col("pred_from_score") == F.col("gt_from_score"), F.lit(False)),
            "correct_score": F.coalesce((ph == gh) & (pa == ga), F.lit(False)),
            "correct_direction": F.coalesce(F.col("pred_over") == F.col("gt_over"), F.lit(False)),
        }
    )


def expand_codes(df: DataFrame, column: str, names: Mapping[str, str]) -> DataFrame:
    """Codes by their names; codes without one pass through."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return df.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))


def format_for_model(df: DataFrame, columns: Sequence[str], minutes: str = "minutes") -> DataFrame:
    """Per-90 rates of the columns; null, NaN and infinite become 0 everywhere."""
    df = df.withColumns({f"{c}_per_90": F.try_divide(F.col(c), F.nullif(F.col(minutes), F.lit(0.0))) * F.lit(90.0) for c in columns})
    numbers = [n for n, t in df.dtypes if t in ("double", "float", "bigint", "int")]

    def clean(name: str) -> Column:
        x = F.col(name)
        return F.when(x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))), F.lit(0)).otherwise(x)

    return df.withColumns({n: clean(n) for n in numbers})


def align_schema(df: DataFrame, target: Mapping[str, Column | str], strict: bool = True) -> DataFrame:
    """The target's columns in its order, each from a column name or an expression.

    ``strict`` raises on columns of the target that name no column, before any data is read.
    """
    missing = [c for c in target.values() if isinstance(c, str) and c not in df.columns]
    if strict and missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in target.items()])


def complete_columns(df: DataFrame, target: Mapping[str, str]) -> DataFrame:
    """The target's columns (name to type) in its order; missing ones are null."""
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in target.items()])


def time_range(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Half-open range of time; reaches the scan as a filter."""
    t = F.col(column)
    return df.filter((t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp")))


def complete_for_regime(df: DataFrame, regime: str) -> DataFrame:
    """Rows with a final score; the halftime regime needs a halftime score too."""
    need = ["home_goals", "away_goals"] + (["halftime_home", "halftime_away"] if regime == "halftime" else [])
    return df.dropna(subset=need)


def first_half_events(events: DataFrame, types: Sequence[str] = ("Goal", "Card")) -> DataFrame:
    return events.filter(F.col("time_elapsed").between(0, 45) & F.col("event_type").isin(*types))
