"""Landed feed JSON to tables: nested structs, arrays and dynamic keys, by schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.functions.scalars import pct_text, stat_key

_SIDE = "struct<id:bigint,name:string>"
_GOALS = "struct<home:bigint,away:bigint>"
FIXTURE = (
    "fixture struct<id:bigint,date:string,referee:string,venue:struct<name:string,city:string>,status:struct<short:string>>, league struct<season:int,round:string>, "
    f"teams struct<home:{_SIDE},away:{_SIDE}>, goals {_GOALS}, score struct<halftime:{_GOALS},fulltime:{_GOALS},extratime:{_GOALS},penalty:{_GOALS}>"
)
_PLAYER = "struct<player:struct<id:bigint,name:string,number:int,pos:string>>"
LINEUP = f"fixture_id bigint, team {_SIDE}, formation string, coach struct<name:string>, startXI array<{_PLAYER}>, substitutes array<{_PLAYER}>"
EVENT = f"fixture_id bigint, events array<struct<time:struct<elapsed:bigint,extra:bigint>,team:{_SIDE},player:{_SIDE},assist:{_SIDE},type:string,detail:string>>"
SEASON = (
    f"response array<struct<player:struct<id:bigint,name:string,nationality:string>,statistics:array<struct<team:{_SIDE},league:struct<id:bigint,season:int>,"
    "games:struct<appearences:double,minutes:double,rating:string>,goals:struct<total:double,assists:double>,fouls:struct<drawn:double,committed:double>,penalty:struct<commited:double>>>>>"
)
PLAYER_MATCH = f"fixture_id bigint, teams array<struct<team:{_SIDE},players:array<struct<player:{_SIDE},statistics:array<struct<games:struct<minutes:double,rating:string>,goals:struct<total:double>>>>>>>"
TEAM_STATS = f"fixture_id bigint, team {_SIDE}, statistics array<struct<type:string,value:string>>"
TEAMS = "response array<struct<team:struct<id:bigint,name:string,country:string>,venue:struct<name:string,capacity:bigint>>>"
SQUADS = f"response array<struct<team:{_SIDE},players:array<struct<id:bigint,name:string,age:bigint,number:bigint,position:string>>>>"


def parsed(df: DataFrame, json: str, schema: str, *keep: str) -> DataFrame:
    """The fields of a JSON column beside the columns to keep; text that isn't JSON gives nulls."""
    return df.select(*keep, F.from_json(json, schema).alias("_j")).select(*keep, "_j.*")


def flatten_fixtures(raw: DataFrame) -> DataFrame:
    """Extra time and penalties are told by their scores; a PEN status tells penalties too."""
    c = F.col
    return raw.select(
        c("fixture.id").alias("fixture_id"),
        c("fixture.date").alias("date"),
        c("fixture.referee").alias("referee"),
        c("fixture.venue.name").alias("venue_name"),
        c("fixture.venue.city").alias("venue_city"),
        c("league.season").alias("season"),
        c("league.round").alias("round"),
        *[c(f"teams.{s}.{f}").alias(f"{s}_team_{f}") for s in ("home", "away") for f in ("id", "name")],
        *[c(f"goals.{s}").alias(f"{s}_goals") for s in ("home", "away")],
        *[c(f"score.halftime.{s}").alias(f"halftime_{s}") for s in ("home", "away")],
        c("score.extratime.home").isNotNull().alias("went_to_extra_time"),
        (c("score.penalty.home").isNotNull() | F.coalesce(c("fixture.status.short") == "PEN", F.lit(False))).alias("went_to_penalties"),
    )


def flatten_lineups(raw: DataFrame) -> DataFrame:
    """Both arrays in one table with two flags, exploded once."""
    tag = lambda a, starts: F.transform(F.coalesce(a, F.array()), lambda x: F.struct(x["player"].alias("player"), F.lit(starts).alias("is_starter")))
    both = F.concat(tag(F.col("startXI"), True), tag(F.col("substitutes"), False))
    out = raw.select("fixture_id", F.col("team.id").alias("team_id"), F.col("team.name").alias("team_name"), "formation", F.col("coach.name").alias("coach"), F.explode(both).alias("p"))
    return out.select(
        "fixture_id", "team_id", "team_name", "formation", "coach", F.col("p.player.id").alias("player_id"), F.col("p.player.name").alias("player_name"), F.col("p.player.number").alias("number"),
        F.col("p.player.pos").alias("position"), "p.is_starter", (~F.col("p.is_starter")).alias("is_substitute"),
    )


def flatten_match_events(raw: DataFrame) -> DataFrame:
    e = raw.select("fixture_id", F.posexplode("events").alias("seq", "e"))
    return e.select(
        "fixture_id", "seq", F.col("e.time.elapsed").alias("time_elapsed"), F.col("e.time.extra").alias("time_extra"), F.col("e.team.name").alias("team_name"), F.col("e.player.name").alias("player_name"),
        F.col("e.assist.name").alias("assist_name"), F.col("e.type").alias("event_type"), F.col("e.detail").alias("event_detail"),
    )


def flatten_player_seasons(raw: DataFrame) -> DataFrame:
    """One row for each entry of statistics; the feed's misspelt names are put right."""
    first = raw.select(F.get("response", F.lit(0)).alias("r")).select("r.player", F.explode("r.statistics").alias("s"))
    return first.select(
        F.col("player.id").alias("player_id"), F.col("player.name").alias("player_name"), F.col("player.nationality").alias("nationality"), F.col("s.team.id").alias("team_id"), F.col("s.league.id").alias("league_id"), F.col("s.league.season").alias("season"),
        F.col("s.games.appearences").alias("appearances"), F.col("s.games.minutes").alias("minutes"), F.col("s.games.rating").try_cast("double").alias("rating"), F.col("s.goals.total").alias("goals"), F.col("s.goals.assists").alias("assists"),
        F.col("s.fouls.committed").alias("fouls_committed"), F.col("s.penalty.commited").alias("penalty_committed"),
    )


def flatten_player_match(raw: DataFrame) -> DataFrame:
    """The first statistics entry of each player; appeared: minutes are known."""
    t = raw.select("fixture_id", F.explode("teams").alias("t")).select("fixture_id", "t.team", F.explode("t.players").alias("p"))
    s = F.try_element_at("p.statistics", F.lit(1))
    return t.select(
        "fixture_id", F.col("team.id").alias("team_id"), F.col("p.player.id").alias("player_id"), s["games"]["minutes"].alias("minutes_played"), s["games"]["rating"].try_cast("double").alias("rating"), s["goals"]["total"].alias("goals_scored"),
        s["games"]["minutes"].isNotNull().alias("appeared"),
    )


def flatten_team_stats(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A key and value array as columns of the given normalised keys; null values count as 0."""
    e = raw.select("fixture_id", F.col("team.id").alias("team_id"), F.explode("statistics").alias("s"))
    e = e.select("fixture_id", "team_id", stat_key(F.col("s.type")).alias("key"), F.coalesce(pct_text(F.col("s.value")), F.lit(0.0)).alias("value"))
    return e.groupBy("fixture_id", "team_id").pivot("key", list(keys)).agg(F.first("value"))


def flatten_teams(raw: DataFrame) -> DataFrame:
    t = raw.select(F.explode("response").alias("r"))
    return t.select(F.col("r.team.id").alias("team_id"), F.col("r.team.name").alias("team_name"), F.col("r.team.country").alias("country"), F.col("r.venue.name").alias("venue_name"), F.col("r.venue.capacity").alias("venue_capacity"))


def flatten_squads(raw: DataFrame) -> DataFrame:
    t = raw.select(F.explode("response").alias("r")).select("r.team", F.explode("r.players").alias("p"))
    return t.select(F.col("team.id").alias("team_id"), F.col("team.name").alias("team_name"), F.col("p.id").alias("player_id"), F.col("p.name").alias("player_name"), F.col("p.age").alias("age"), F.col("p.number").alias("number"), F.col("p.position").alias("position"))


def flatten_ohlc(df: DataFrame, json: str, key: str, start: Column | None = None, end: Column | None = None, dedupe: bool = False) -> DataFrame:
    """Candles of arrays of arrays under a dynamic key; pages may overlap, ``dedupe`` drops repeats."""
    result = F.map_filter(F.from_json(F.get_json_object(json, "$.result"), "map<string,string>"), lambda k, v: k != "last")
    e = df.select(key, F.explode(result).alias("pair", "rows")).select(key, "pair", F.explode(F.from_json("rows", "array<array<string>>")).alias("r"))
    names = ("open", "high", "low", "close", "vwap", "volume")
    at = lambda i: F.get("r", F.lit(i))
    out = e.select("pair", F.timestamp_seconds(at(0).try_cast("bigint")).alias("time"), *[at(i + 1).try_cast("double").alias(n) for i, n in enumerate(names)], at(7).try_cast("bigint").alias("trades"))
    if start is not None:
        out = out.filter(F.col("time") >= start)
    if end is not None:
        out = out.filter(F.col("time") < end)
    return out.dropDuplicates(["pair", "time"]) if dedupe else out


def flatten_chart_json(df: DataFrame, json: str, key: str) -> DataFrame:
    e = df.select(key, F.explode(F.from_json(json, "values array<struct<x:bigint,y:double>>")["values"]).alias("v"))
    return e.select(key, F.timestamp_seconds("v.x").alias("time"), F.col("v.y").alias("value"))
