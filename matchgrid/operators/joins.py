"""Joins and set operations. Equi keys come first; ranges stay as residual conditions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side of this many rows at most is broadcast; beyond it Spark shuffles and may re-plan.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint for a side that is known to be small: counted up to the bound, no further."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def attach(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """Left equi join; columns of ``other`` that ``df`` has too are left out."""
    keys = [on] if isinstance(on, str) else on
    extra = [x for x in other.columns if x in keys or x not in df.columns]
    return df.join(other.select(*extra), keys, "left")


def pair_on_match(a: DataFrame, b: DataFrame, keys: Sequence[str], suffixes: tuple[str, str] = ("_a", "_b"), strict: bool = True) -> DataFrame:
    """Inner join of two prediction tables row by row.

    ``strict`` raises if a side repeats a key or a row finds no partner: three counts, made on
    the cluster, are read by the driver.
    """
    left = a.select(*keys, *[F.col(x).alias(x + suffixes[0]) for x in a.columns if x not in keys])
    right = b.select(*keys, *[F.col(x).alias(x + suffixes[1]) for x in b.columns if x not in keys])
    if strict:
        for side in (a, b):
            n = side.groupBy(*keys).count().agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
            if (n["most"] or 0) > 1:
                raise ValueError("duplicate keys")
        if left.select(*keys).join(right.select(*keys), list(keys), "left_anti").limit(1).count() or right.select(*keys).join(left.select(*keys), list(keys), "left_anti").limit(1).count():
            raise ValueError("rows without a partner")
    return left.join(right, list(keys))


def starters_with_history(starters: DataFrame, player_season: DataFrame, lookback: int = 3) -> DataFrame:
    """Each starter with each of the player's seasons in the ``lookback`` years before the match.

    Joined on the player, with the range as residual; ``season`` of the history is ``past``.
    """
    past = player_season.withColumnRenamed("season", "past").withColumnsRenamed({x: f"past_{x}" for x in ("player_name", "position") if x in player_season.columns})
    lower, upper = F.col("season") - lookback, F.col("season")
    return starters.join(past, "player_id").filter((F.col("past") >= lower) & (F.col("past") < upper))


def prior_tournaments(matches: DataFrame, team_match: DataFrame, team: str) -> DataFrame:
    """Number, goals and last season of the matches that the named team played in strictly earlier seasons."""
    # earlier seasons in one row each, as in head_to_head: no match meets another
    past = team_match.groupBy(F.col("team_name").alias(team), F.col("season").alias("past")).agg(F.count("*").alias("n"), F.sum("scored").alias("scored"))
    prior = matches.select("fixture_id", "season", team).join(past, team).filter("past < season")
    return prior.groupBy("fixture_id").agg(F.sum("n").alias("n"), F.sum("scored").alias("scored"), F.max("past").alias("last"))


def with_head_to_head(matches: DataFrame) -> DataFrame:
    """``matches`` with ``h2h``: earlier meetings of the two teams in either role, seen from the home side.

    Meetings are counted by pair and season and summed up over the seasons; a match joins the sum
    before its season by equality, so its row meets one other.
    """
    h, a = F.col("home_team_name"), F.col("away_team_name")
    won_by = F.when(F.col("home_goals") > F.col("away_goals"), h).when(F.col("home_goals") < F.col("away_goals"), a)
    pair = [F.least(h, a).alias("_x"), F.greatest(h, a).alias("_y")]
    met = matches.filter(F.col("season").isNotNull()).select(*pair, "season", won_by.alias("winner")).groupBy("_x", "_y", "season")
    met = met.agg(F.count("*").alias("n"), F.count_if(F.col("winner") == F.col("_x")).alias("wx"), F.count_if(F.col("winner") == F.col("_y")).alias("wy"))
    before = Window.partitionBy("_x", "_y").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    past = met.select("_x", "_y", "season", F.struct(*[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in ("n", "wx", "wy")]).alias("_past"))
    home_is_x = h == F.col("_x")
    of = lambda name: F.coalesce(F.col("_past")[name], F.lit(0))
    one, two = F.when(home_is_x, of("wx")).otherwise(of("wy")), F.when(home_is_x, of("wy")).otherwise(of("wx"))
    h2h = F.struct(of("n").alias("matches"), one.alias("team1_wins"), two.alias("team2_wins"), (of("n") - of("wx") - of("wy")).alias("draws"))
    return matches.select("*", *pair).join(past, ["_x", "_y", "season"], "left").select(*matches.columns, h2h.alias("h2h"))


def head_to_head(matches: DataFrame) -> DataFrame:
    """(fixture_id, matches, team1_wins, team2_wins, draws) of each match's earlier meetings."""
    needed = matches.select("fixture_id", "season", "home_team_name", "away_team_name", "home_goals", "away_goals")
    return with_head_to_head(needed).select("fixture_id", "h2h.*")


def attach_events(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Each match's goals, cards and substitutions as ordered lists of structs; empty if none."""
    item = F.struct("event_id", "time_elapsed", "team_name", "player_name")

    def listed(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, item)))

    lists = events.groupBy("fixture_id").agg(listed("Goal").alias("goals"), listed("Card").alias("cards"), listed("Substitution").alias("substitutions"))
    out = matches.join(lists, "fixture_id", "left")
    return out.withColumns({x: F.coalesce(x, F.array()) for x in ("goals", "cards", "substitutions")})


def attach_sides(matches: DataFrame, per_team: DataFrame, name: str = "profile") -> DataFrame:
    """``matches`` with ``home_<name>`` and ``away_<name>``: the team's row of ``per_team``, null if there is none.

    ``per_team`` has one row at most for a fixture and team; a second one is an error, and rows
    without a team belong to no side. A fixture's rows are put together first, so a match is joined
    once for both sides.
    """
    rest = [x for x in per_team.columns if x not in ("fixture_id", "team_id")]
    rows = F.map_from_entries(F.collect_list(F.struct("team_id", F.struct(*rest))))  # fails on equal teams
    sides = per_team.filter("team_id is not null").groupBy("fixture_id").agg(rows.alias("_sides"))
    of = lambda side: F.try_element_at("_sides", F.col(f"{side}_team_id"))
    out = matches.join(sides, "fixture_id", "left")
    return out.select(*matches.columns, of("home").alias(f"home_{name}"), of("away").alias(f"away_{name}"))


def attach_two_profiles(matches: DataFrame, profiles: DataFrame) -> DataFrame:
    """The profile table, of one row for a fixture and team, joined in the home and in the away role."""
    rest = [x for x in profiles.columns if x not in ("fixture_id", "team_id")]
    flat = [F.col(f"{side}_profile")[x].alias(f"{side}_{x}") for side in ("home", "away") for x in rest]
    return attach_sides(matches, profiles).select(*matches.columns, *flat)


def attach_opponent(lineups: DataFrame, matches: DataFrame) -> DataFrame:
    """is_home and the opponent; a team of neither side gets the home team."""
    m = matches.select("fixture_id", "home_team_id", "home_team_name", "away_team_id", "away_team_name")
    home = F.coalesce(F.col("team_id") == F.col("home_team_id"), F.lit(False))
    out = lineups.join(m, "fixture_id", "left").withColumn("is_home", home)
    out = out.withColumn("opponent_id", F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id")))
    out = out.withColumn("opponent_name", F.when(home, F.col("away_team_name")).otherwise(F.col("home_team_name")))
    return out.drop("home_team_id", "home_team_name", "away_team_id", "away_team_name")


def semi(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(other.select(on), on, "left_semi")


def append_new(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``df`` and the rows of ``other`` whose key it doesn't have."""
    return append_all(df, other.join(df.select(key), key, "left_anti"))


def season_gaps(squads: DataFrame, stats: DataFrame, seasons: Iterable[int]) -> DataFrame:
    """(player_id, season) that are expected of the squads and absent from the statistics."""
    expected = squads.select("player_id", F.explode(F.array(*[F.lit(s) for s in seasons])).alias("season")).distinct()
    return expected.join(stats.select("player_id", "season").distinct(), ["player_id", "season"], "left_anti")


def config_grid(df: DataFrame, fractions: Sequence[float], caps: Sequence[float]) -> DataFrame:
    """Every row under every setting, as an exploded literal: nothing is joined."""
    grid = F.array(*[F.struct(F.lit(f).alias("kelly_fraction"), F.lit(x).alias("cap")) for f in fractions for x in caps])
    return df.withColumn("_g", F.explode(grid)).select("*", "_g.kelly_fraction", "_g.cap").drop("_g")


def membership_expand(registry: DataFrame, teams: str = "wc_teams") -> DataFrame:
    """One row for each team of a comma-joined list."""
    return registry.withColumn("team", F.explode(F.split(teams, r",\s*"))).drop(teams)


def fixtures_of_teams(matches: DataFrame, team_ids: DataFrame) -> DataFrame:
    """Matches in which either side is in the set."""
    sides = matches.select("fixture_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    hit = sides.join(team_ids.select("team_id"), "team_id", "left_semi").select("fixture_id").distinct()
    return matches.join(hit, "fixture_id", "left_semi")


def pending_keys(everything: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return everything.select(key).join(done.select(key), key, "left_anti")


def append_all(*frames: DataFrame) -> DataFrame:
    """Rows of all; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def shared_teams(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def only_in_left(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def teams_of_season(matches: DataFrame) -> DataFrame:
    """(season, team): names of either role, once."""
    return matches.select("season", F.explode(F.array("home_team_name", "away_team_name")).alias("team")).distinct()


def named_and_anonymised(df: DataFrame) -> DataFrame:
    return df.withColumn("anonymized", F.explode(F.array(F.lit(False), F.lit(True))))
