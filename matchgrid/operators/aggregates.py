"""Aggregations. Spark splits them into partial and final steps; nothing is collected whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions.scalars import half_even, half_even_of_sum

RATES = ["rating", "passes_accuracy", "goals_per_90", "assists_per_90", "goal_contributions_per_90", "shot_accuracy", "duel_win_pct", "tackles_per_90", "dribble_success_pct"]
PROFILE_SUMS = ["goals", "assists", "appearances", "minutes", "shots_total", "shots_on_target", "cards_yellow", "cards_red"]
PROFILE_MEANS = ["rating", "passes_accuracy", "goals_per_90", "assists_per_90", "goal_contributions_per_90", "tackles_per_90", "duel_win_pct", "dribble_success_pct"]


def sum_or_null(column: str) -> Column:
    """Null if all values are: Spark's own sum."""
    return F.sum(column)


def sum_or_zero(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def aggregate_player_seasons(df: DataFrame, sums: Sequence[str], means: Sequence[str]) -> DataFrame:
    """One row for each player and season; rows without either key are left out."""
    keyed = df.filter(F.col("player_id").isNotNull() & F.col("season").isNotNull())
    return keyed.groupBy("player_id", "season").agg(*[sum_or_null(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means])


def player_seasons(raw: DataFrame, sums: Sequence[str], means: Sequence[str]) -> DataFrame:
    """One row for each player and season: sums, means and the greatest position.

    Rows are added up by position first, so that all that is kept while the raw rows are read has a
    fixed size: they are hashed. The greatest text among them would have them sorted.
    """
    keys = ["player_id", "season"]
    parts = raw.groupBy(*keys, "position").agg(*[F.sum(c).alias(c) for c in dict.fromkeys([*sums, *means])], *[F.count(c).alias(f"n_{c}") for c in means])
    mean = lambda c: F.try_divide(F.sum(c), F.sum(f"n_{c}").cast("double"))
    return parts.groupBy(*keys).agg(F.max("position").alias("position"), *[F.sum(c).alias(c) for c in sums], *[mean(c).alias(c) for c in means])


def first_known_meta(df: DataFrame, columns: Sequence[str], key: str = "player_id", order: Sequence[str] = ("season", "team_id", "league_id")) -> DataFrame:
    """For each key and column the earliest value that isn't null."""
    at = F.struct(*order)
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def lookback_form(history: DataFrame, keys: Sequence[str], sums: Sequence[str], rates: Sequence[str] = RATES) -> DataFrame:
    """Sums (0 if all null) and means (null if all null) of a player's earlier seasons."""
    rates = [r for r in rates if r in history.columns]
    return history.groupBy(*keys).agg(
        *[sum_or_zero(c).alias(c) for c in sums],
        *[F.avg(c).alias(c) for c in rates],
        F.count("*").alias("seasons_with_data"),
        F.max_by("past_position", "past").alias("form_position"),
    )


def form_by_season(player_season: DataFrame, sums: Sequence[str], rates: Sequence[str] = RATES, lookback: int = 3) -> DataFrame:
    """A player's look-back form at each season that follows a season of theirs by at most ``lookback``.

    Made once for a player and season, however many matches use it; they join it by equality.
    """
    later = F.explode(F.sequence(F.col("past") + 1, F.col("past") + lookback))
    past = player_season.withColumnsRenamed({"season": "past", "position": "past_position"}).withColumn("season", later)
    return lookback_form(past, ["player_id", "season"], sums, rates)


def has_form() -> Column:
    return F.col("seasons_with_data").isNotNull()


def team_profile(form: DataFrame, keys: Sequence[str] = ("fixture_id", "team_id"), extra: Sequence[Column] = ()) -> DataFrame:
    """Team totals (1 place) and means (2 places) over starters with earlier seasons.

    Both are first rounded to nine places, so that the order of addition never shows. Teams none of whose starters has any don't appear.
    ``form`` may hold starters without earlier seasons, with nulls for their form. ``extra`` aggregates are made in the same pass.
    """
    sums = [c for c in PROFILE_SUMS if c in form.columns]
    means = [c for c in PROFILE_MEANS if c in form.columns]
    return form.groupBy(*keys).agg(
        F.count("seasons_with_data").alias("num_starters_with_data"),
        *[half_even_of_sum(F.sum(c), 1).alias(f"team_total_{c}") for c in sums],
        *[half_even_of_sum(F.avg(c), 2).alias(f"team_avg_{c}") for c in means],
        *extra,
    ).filter("num_starters_with_data > 0")


def position_of(lineup: str = "position", career: str = "form_position") -> Column:
    return F.coalesce(F.nullif(F.col(lineup), F.lit("")), F.col(career), F.lit("Unknown"))


def position_breakdown(form: DataFrame, keys: Sequence[str] = ("fixture_id", "team_id")) -> DataFrame:
    """A map of counts by position, in order of position."""
    counts = form.withColumn("pos", position_of()).groupBy(*keys, "pos").count()
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pos", "count")))).alias("position_breakdown"))


def player_summaries(form: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("fixture_id", "team_id"), order: Sequence[str] = ("number", "player_id")) -> DataFrame:
    """An ordered list of structs, one for each starter with data, 2 places."""
    item = F.struct(*order, position_of().alias("position"), *[half_even(F.col(c), 2).alias(c) for c in columns])
    return form.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("player_summaries"))


def squad_counts(lineups: DataFrame) -> DataFrame:
    """Squad size and number of substitutes beside every line."""
    w = Window.partitionBy("fixture_id", "team_id")
    return lineups.withColumns({"squad_size": F.count("*").over(w), "num_substitutes": F.count_if("is_substitute").over(w)})


def career_totals(df: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Totals, mean rating and span of seasons of each player, with unrounded per-90 rates."""
    out = df.groupBy("player_id", "player_name", "nationality").agg(
        *[sum_or_zero(c).alias(c) for c in sums], F.avg("rating").alias("rating"), F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.countDistinct("season").alias("seasons")
    )
    return out.withColumns({f"{c}_per_90": F.try_divide(F.col(c), F.nullif(F.col("minutes"), F.lit(0.0))) * F.lit(90.0) for c in ("goals", "assists", "tackles_total")})


def career_summary(df: DataFrame) -> DataFrame:
    """Most frequent position (ties to the smallest), distinct seasons, teams and leagues, totals."""
    return df.groupBy("player_id").agg(
        F.mode("position", True).alias("main_position"),
        F.countDistinct("season").alias("seasons"),
        F.countDistinct("team_id").alias("teams"),
        F.countDistinct("league_id").alias("leagues"),
        sum_or_zero("goals").alias("goals"),
        sum_or_zero("minutes").alias("minutes"),
    )


def team_strength(squads: DataFrame, player_season: DataFrame) -> DataFrame:
    """Size, age, experience, and rating and goals of the team's latest season."""
    joined = squads.join(player_season.select("player_id", "season", "rating", "goals", "assists", "appearances"), "player_id", "left")
    size = squads.groupBy("team_id").agg(F.count("*").alias("squad_size"), F.avg("age").alias("avg_age"))
    seasons = joined.groupBy("team_id", "player_id").agg(F.countDistinct("season").alias("n")).groupBy("team_id").agg(F.avg("n").alias("avg_experience"))
    latest = joined.groupBy("team_id").agg(F.max("season").alias("season"))
    form = joined.join(latest, ["team_id", "season"]).groupBy("team_id")
    form = form.agg(F.avg("rating").alias("avg_rating"), sum_or_zero("goals").alias("total_goals"), sum_or_zero("assists").alias("total_assists"), sum_or_zero("appearances").alias("total_appearances"))
    return size.join(seasons, "team_id").join(form, "team_id", "left")


def _kind(name: str) -> Column:
    return F.col("type") == name


#: Measures of a team's match: name to the condition that its events are counted by.
TEAM_MEASURES: dict[str, Column] = {}


def team_measures() -> dict[str, Column]:
    """Conditions over flat play events (type, outcome, subtype, body_part, height, technique,
    length, is_cross, card), by measure."""
    if TEAM_MEASURES:
        return TEAM_MEASURES
    c = F.col
    is_ = lambda column, *names: F.coalesce(c(column).isin(*names), F.lit(False))
    shot, pass_, duel, keeper = _kind("Shot"), _kind("Pass"), _kind("Duel"), _kind("Goal Keeper")
    long = F.coalesce(c("length"), F.lit(0.0)) > 32
    set_piece = is_("subtype", "Corner", "Free Kick", "Goal Kick", "Throw-in", "Kick Off")
    card = _kind("Foul Committed") | _kind("Bad Behaviour")
    out = {"total_shots": shot, "shots_on_target": shot & is_("outcome", "Goal", "Saved"), "shots_off_target": shot & is_("outcome", "Off T", "Wayward", "Post"), "shots_blocked": shot & is_("outcome", "Blocked")}
    out |= {f"shots_{n}": shot & is_("subtype", v) for n, v in (("open_play", "Open Play"), ("free_kick", "Free Kick"), ("penalty", "Penalty"))}
    out |= {f"shots_{n}": shot & is_("body_part", v) for n, v in (("right_foot", "Right Foot"), ("left_foot", "Left Foot"), ("header", "Head"))}
    out |= {"total_passes": pass_, "passes_completed": pass_ & c("outcome").isNull(), "passes_incomplete": pass_ & c("outcome").isNotNull()}
    out |= {"long_passes": pass_ & long, "long_passes_completed": pass_ & long & c("outcome").isNull(), "short_passes": pass_ & ~long & ~set_piece}
    out |= {f"{n}_passes": pass_ & is_("height", v) for n, v in (("ground", "Ground Pass"), ("low", "Low Pass"), ("high", "High Pass"))}
    out |= {"through_balls": pass_ & is_("technique", "Through Ball"), "crosses": pass_ & F.coalesce(c("is_cross"), F.lit(False))}
    out |= {n: pass_ & is_("subtype", v) for n, v in (("corners", "Corner"), ("free_kicks", "Free Kick"), ("goal_kicks", "Goal Kick"), ("throw_ins", "Throw-in"), ("kick_offs", "Kick Off"))}
    out |= {"fouls_committed": _kind("Foul Committed"), "fouls_won": _kind("Foul Won"), "handballs": _kind("Foul Committed") & is_("subtype", "Handball")}
    out |= {"yellow_cards": card & is_("card", "Yellow Card", "Second Yellow"), "red_cards": card & is_("card", "Red Card", "Second Yellow"), "second_yellows": card & is_("card", "Second Yellow")}
    out |= {"offsides": pass_ & is_("outcome", "Pass Offside"), "clearances": _kind("Clearance"), "interceptions": _kind("Interception"), "blocks": _kind("Block"), "ball_recoveries": _kind("Ball Recovery")}
    out |= {"tackles": duel & is_("subtype", "Tackle"), "tackles_won": duel & is_("subtype", "Tackle") & is_("outcome", "Won", "Success In Play"), "aerial_duels_lost": duel & is_("subtype", "Aerial Lost")}
    out |= {"pressures": _kind("Pressure"), "dribbles_attempted": _kind("Dribble"), "dribbles_completed": _kind("Dribble") & is_("outcome", "Won", "Complete")}
    out |= {"dispossessed": _kind("Dispossessed"), "miscontrols": _kind("Miscontrol")}
    out |= {f"gk_{n}": keeper & is_("subtype", v) for n, v in (("saves", "Shot Saved"), ("punches", "Punch"), ("claims", "Collected"), ("sweeper", "Keeper Sweeper"))}
    out |= {"substitutions": _kind("Substitution"), "fifty_fiftys": _kind("50/50")}
    TEAM_MEASURES.update(out)
    return out


def team_match_stats(plays: DataFrame) -> DataFrame:
    """All measures of each team and match in one pass; the opponent's by a join on the match."""
    own = plays.groupBy("match_id", "team").agg(
        *[F.count_if(cond).alias(name) for name, cond in team_measures().items()],
        half_even(F.sum(F.when(_kind("Shot"), F.coalesce("xg", F.lit(0.0))).otherwise(0.0)), 4).alias("xg"),
        F.coalesce(half_even(F.avg(F.when(_kind("Pass"), F.coalesce("length", F.lit(0.0)))), 2), F.lit(0.0)).alias("avg_pass_length"),
    )
    other = own.select("match_id", F.col("team").alias("opponent"), F.col("xg").alias("xg_conceded"), F.col("aerial_duels_lost").alias("aerial_duels_won"))
    out = own.join(other, "match_id").filter("team <> opponent")
    return out.withColumns({"aerial_duels": F.col("aerial_duels_lost"), "aerial_duels_total": F.col("aerial_duels_won") + F.col("aerial_duels_lost")})


def possession_share(plays: DataFrame) -> DataFrame:
    """Share of events in possession (1 place, 50.0 if there is none) and distinct sequences."""
    teams = plays.select("match_id", "team").distinct()
    total = plays.groupBy("match_id").agg(F.count("possession_team").alias("n"))
    held = plays.groupBy("match_id", F.col("possession_team").alias("team")).agg(F.count("*").alias("k"), F.countDistinct("possession").alias("possession_sequences"))
    out = teams.join(total, "match_id").join(held, ["match_id", "team"], "left")
    share = half_even(F.try_divide(F.coalesce("k", F.lit(0)).cast("double") * 100.0, F.nullif(F.col("n"), F.lit(0)).cast("double")), 1)
    return out.select("match_id", "team", F.coalesce(share, F.lit(50.0)).alias("ball_possession_pct"), F.coalesce("possession_sequences", F.lit(0)).alias("possession_sequences"))


def player_registry(df: DataFrame) -> DataFrame:
    """Latest name, distinct years in order, and teams in order of their first year."""
    first = df.groupBy("player_id", "team_id").agg(F.min("season").alias("since"))
    teams = first.groupBy("player_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("since", "team_id"))), lambda x: x["team_id"]).alias("teams"))
    named = df.groupBy("player_id").agg(F.max_by("player_name", "season").alias("player_name"), F.array_sort(F.collect_set("season")).alias("years"))
    return named.join(teams, "player_id")


def season_report(matches: DataFrame, lineups: DataFrame, events: DataFrame) -> DataFrame:
    per = matches.groupBy("season").agg(
        F.count("*").alias("matches"), F.count_if("went_to_extra_time").alias("extra_time"), F.count_if("went_to_penalties").alias("penalties"), F.sum(F.col("home_goals") + F.col("away_goals")).alias("goals")
    )
    teams = matches.select("season", F.explode(F.array("home_team_name", "away_team_name")).alias("t")).groupBy("season").agg(F.countDistinct("t").alias("teams"))
    seen = lineups.select("fixture_id").distinct().join(matches.select("fixture_id", "season"), "fixture_id").groupBy("season").agg(F.count("*").alias("with_lineups"))
    kinds = events.join(matches.select("fixture_id", "season"), "fixture_id").groupBy("season").agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k.lower()}") for k in ("Goal", "Card", "Substitution")])
    out = per.join(teams, "season").join(seen, "season", "left").join(kinds, "season", "left")
    return out.fillna(0)


def sample_size_stats(samples: DataFrame, group: str, text: Column, budget: int = 625) -> DataFrame:
    """Characters of the samples of each set, tokens at four characters each, and an over-budget flag."""
    n = F.length(text)
    out = samples.groupBy(group).agg(F.count("*").alias("samples"), F.min(n).alias("min_chars"), F.avg(n).alias("avg_chars"), F.max(n).alias("max_chars"))
    return out.withColumn("max_tokens", F.expr("max_chars div 4")).withColumn("over_budget", F.col("max_tokens") > budget)


def column_completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each column from one pass: values, their share in percent, values above zero."""
    parts = [x for c in columns for x in (F.count(c).alias(f"{c}__n"), F.count_if(F.col(c) > 0).alias(f"{c}__p"))]
    one = df.agg(F.count("*").alias("rows"), *parts)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("known"), F.col(f"{c}__p").alias("positive")) for c in columns])
    out = one.select("rows", F.explode(rows).alias("r")).select("rows", "r.*")
    return out.withColumn("pct", half_even(F.try_divide(F.col("known").cast("double") * 100.0, F.nullif(F.col("rows"), F.lit(0)).cast("double")), 1))


def table_overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.countDistinct("player_id").alias("players"),
        F.countDistinct("team_id").alias("teams"),
        F.min("season").alias("first_season"),
        F.max("season").alias("last_season"),
        F.array_join(F.transform(F.array_sort(F.collect_set("season")), lambda s: s.cast("string")), ",").alias("seasons"),
    )
