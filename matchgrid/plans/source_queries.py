"""Queries S5-S16, R1, R2 and X2: feed JSON is made of the given tables and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from matchgrid.plans.registry import query
from matchgrid.sources import feeds
from matchgrid.streaming import streams

c, lit = F.col, F.lit


def _fixtures(v):
    pair = lambda h, a: F.struct(h.alias("home"), a.alias("away"))
    side = lambda s: F.struct(c(f"{s}_team_id").alias("id"), c(f"{s}_team_name").alias("name"))
    extra = F.when(F.coalesce("went_to_extra_time", lit(False)), lit(1))
    fixture = F.struct(c("fixture_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.struct(c("venue").alias("name")).alias("venue"), F.struct(F.when(F.coalesce("went_to_penalties", lit(False)), "PEN").otherwise("FT").alias("short")).alias("status"))
    j = F.struct(
        fixture.alias("fixture"), F.struct("season", "round").alias("league"), F.struct(side("home").alias("home"), side("away").alias("away")).alias("teams"), pair(c("home_goals"), c("away_goals")).alias("goals"),
        F.struct(pair(c("halftime_home"), c("halftime_away")).alias("halftime"), pair(extra, extra).alias("extratime")).alias("score"),
    )
    return v.matches.select(F.to_json(j).alias("j"))


FIXTURE_SQL = "SELECT fixture_id, strftime(ts, '%Y-%m-%d') AS date, venue AS venue_name, season, round, home_team_id, home_team_name, away_team_id, home_goals, away_goals, halftime_home, coalesce(went_to_extra_time, false) AS went_to_extra_time, coalesce(went_to_penalties, false) AS went_to_penalties FROM matches"
FIXTURE_COLUMNS = "fixture_id date venue_name season round home_team_id home_team_name away_team_id home_goals away_goals halftime_home went_to_extra_time went_to_penalties".split()


@query("s06_flatten_fixtures", FIXTURE_SQL)
def s06(v):
    return feeds.flatten_fixtures(feeds.parsed(_fixtures(v), "j", feeds.FIXTURE)).select(*FIXTURE_COLUMNS)


@query("s13_competition_fixtures", f"SELECT * FROM ({FIXTURE_SQL}) x WHERE home_team_id IN (4, 5) OR away_team_id IN (4, 5)")
def s13(v):
    from matchgrid.operators.joins import fixtures_of_teams

    flat = feeds.flatten_fixtures(feeds.parsed(_fixtures(v), "j", feeds.FIXTURE)).select(*FIXTURE_COLUMNS)
    return fixtures_of_teams(flat, v.teams.filter(c("team_id").isin(4, 5)))


@query("s07_flatten_lineups", "SELECT fixture_id, team_id, player_id, number::INTEGER AS number, position, is_starter, is_substitute FROM lineups")
def s07(v):
    player = F.struct(F.struct(c("player_id").alias("id"), c("number").cast("int").alias("number"), c("position").alias("pos")).alias("player"))
    j = v.lineups.groupBy("fixture_id", "team_id").agg(F.collect_list(F.when(c("is_starter"), player)).alias("startXI"), F.collect_list(F.when(c("is_substitute"), player)).alias("substitutes"))
    j = j.select(F.to_json(F.struct("fixture_id", F.struct(c("team_id").alias("id")).alias("team"), "startXI", "substitutes")).alias("j"))
    return feeds.flatten_lineups(feeds.parsed(j, "j", feeds.LINEUP)).select("fixture_id", "team_id", "player_id", "number", "position", "is_starter", "is_substitute")


@query("s08_flatten_match_events", "SELECT fixture_id, time_elapsed, time_extra, team_name, player_name, event_type FROM match_events")
def s08(v):
    e = F.struct(F.struct(c("time_elapsed").alias("elapsed"), c("time_extra").alias("extra")).alias("time"), F.struct(c("team_name").alias("name")).alias("team"), F.struct(c("player_name").alias("name")).alias("player"), c("event_type").alias("type"))
    j = v.match_events.groupBy("fixture_id").agg(F.collect_list(e).alias("events")).select(F.to_json(F.struct("fixture_id", "events")).alias("j"))
    return feeds.flatten_match_events(feeds.parsed(j, "j", feeds.EVENT)).select("fixture_id", "time_elapsed", "time_extra", "team_name", "player_name", "event_type")


@query("s09_flatten_player_seasons", "SELECT player_id, team_id, league_id, season, appearances, minutes, rating, goals, assists FROM player_season_raw")
def s09(v):
    stat = F.struct(
        F.struct(c("team_id").alias("id")).alias("team"), F.struct(c("league_id").alias("id"), "season").alias("league"), F.struct(c("appearances").alias("appearences"), "minutes", c("rating").cast("string").alias("rating")).alias("games"),
        F.struct(c("goals").alias("total"), "assists").alias("goals"),
    )
    j = v.player_season_raw.groupBy("player_id", "season").agg(F.collect_list(stat).alias("statistics"))
    j = j.select(F.to_json(F.struct(F.array(F.struct(F.struct(c("player_id").alias("id")).alias("player"), "statistics")).alias("response"))).alias("j"))
    return feeds.flatten_player_seasons(feeds.parsed(j, "j", feeds.SEASON)).select("player_id", "team_id", "league_id", "season", "appearances", "minutes", "rating", "goals", "assists")


@query("s10_flatten_player_match", "SELECT batch_id AS fixture_id, team_id, player_id, minutes AS minutes_played, rating, goals AS goals_scored, true AS appeared FROM player_season_raw")
def s10(v):
    stat = F.array(F.struct(F.struct("minutes", c("rating").cast("string").alias("rating")).alias("games"), F.struct(c("goals").alias("total")).alias("goals")))
    p = F.struct(F.struct(c("player_id").alias("id")).alias("player"), stat.alias("statistics"))
    team = v.player_season_raw.groupBy(c("batch_id").alias("fixture_id"), "team_id").agg(F.collect_list(p).alias("players"))
    j = team.groupBy("fixture_id").agg(F.collect_list(F.struct(F.struct(c("team_id").alias("id")).alias("team"), "players")).alias("teams")).select(F.to_json(F.struct("fixture_id", "teams")).alias("j"))
    return feeds.flatten_player_match(feeds.parsed(j, "j", feeds.PLAYER_MATCH))


@query("s11_flatten_team_stats", "SELECT fixture_id, home_team_id AS team_id, (home_goals * 10)::DOUBLE AS ball_possession, coalesce(halftime_home, 0)::DOUBLE AS total_shots, CASE WHEN fixture_id % 3 = 0 THEN 0.0::DOUBLE ELSE (away_goals * 7)::DOUBLE END AS passes_pct FROM matches")
def s11(v):
    item = lambda t, x: F.struct(lit(t).alias("type"), x.cast("string").alias("value"))
    stats = F.array(item("Ball Possession", F.concat((c("home_goals") * 10).cast("string"), lit("%"))), item("Total Shots", c("halftime_home")), item("Passes %", F.when(c("fixture_id") % 3 > 0, F.concat((c("away_goals") * 7).cast("string"), lit("%")))))
    j = v.matches.select(F.to_json(F.struct("fixture_id", F.struct(c("home_team_id").alias("id")).alias("team"), stats.alias("statistics"))).alias("j"))
    return feeds.flatten_team_stats(feeds.parsed(j, "j", feeds.TEAM_STATS), ["ball_possession", "total_shots", "passes_pct"])


@query("s12_flatten_squads", "SELECT q.team_id, t.team_name, q.player_id, q.player_name, q.age, q.number FROM squads q JOIN teams t ON q.team_id = t.team_id")
def s12(v):
    p = F.struct(c("player_id").alias("id"), c("player_name").alias("name"), "age", "number")
    j = v.squads.join(v.teams, "team_id").groupBy("team_id", "team_name").agg(F.collect_list(p).alias("players"))
    j = j.select(F.to_json(F.struct(F.array(F.struct(F.struct(c("team_id").alias("id"), c("team_name").alias("name")).alias("team"), "players")).alias("response"))).alias("j"))
    return feeds.flatten_squads(feeds.parsed(j, "j", feeds.SQUADS)).drop("position")


@query("s14_flatten_ohlc", "SELECT 'S' || symbol AS pair, make_timestamp((1700000000 + event_id) * 1000000) AS time, price AS open, quantity::DOUBLE AS volume, 3::BIGINT AS trades FROM fills WHERE event_id >= 1000")
def s14(v):
    p, q = c("price").cast("string"), c("quantity").cast("string")
    row = F.array((lit(1700000000) + c("event_id")).cast("string"), p, p, p, p, p, q, lit("3"))
    rows = v.fills.groupBy("symbol", F.expr("event_id div 500").alias("page")).agg(F.to_json(F.collect_list(row)).alias("rows"))
    j = rows.select("page", F.concat(lit('{"error":[],"result":{"S'), c("symbol").cast("string"), lit('":'), c("rows"), lit(',"last":1700000000}}')).alias("j"))
    return feeds.flatten_ohlc(j, "j", "page", start=F.timestamp_seconds(lit(1700001000))).select("pair", "time", "open", "volume", "trades")


def chart_pages(fills):
    """(symbol, page, j): the fills of a symbol as chart JSON, at most 500 ids to a page."""
    point = F.struct((lit(1700000000) + c("event_id")).alias("x"), c("price").alias("y"))
    return fills.groupBy("symbol", F.expr("event_id div 500").alias("page")).agg(F.to_json(F.struct(F.collect_list(point).alias("values"))).alias("j"))


@query("s15_flatten_chart_json", "SELECT symbol, make_timestamp((1700000000 + event_id) * 1000000) AS time, price AS value FROM fills")
def s15(v):
    return feeds.flatten_chart_json(chart_pages(v.fills), "j", "symbol")


@query("x02_grouped_apply", "SELECT symbol, event_id, price - min(price) OVER (PARTITION BY symbol) AS above_low FROM fills")
def x02(v):
    return above_low(v.fills)


def above_low(fills):
    """Fills with their price above the symbol's low: the low by a combined minimum, the function on pages of at most 50,000 ids."""

    def apply(p: pd.DataFrame) -> pd.DataFrame:
        return p.assign(above_low=p["price"] - p["low"])[["symbol", "event_id", "above_low"]]

    rows = fills.select("symbol", "event_id", "price", F.expr("event_id div 50000").alias("page"))
    low = rows.groupBy(c("symbol").alias("s")).agg(F.min("price").alias("low"))
    return streams.grouped_apply(rows.join(low, c("symbol").eqNullSafe(c("s"))), ["symbol", "page"], apply, "symbol bigint, event_id bigint, above_low double")


FILL_COLUMNS = "event_id", "symbol", "taker_side", "price", "quantity", "ts", "time_ns"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _arrived(v):
    """(windows, late fills) after four arrivals, each with a run of its own that goes on where the
    last one stopped. An arrival is a quarter of the time; one fill in 23 comes with the last."""
    folder = streams.shared_folder(v.spark, "stream")
    fills = v.fills.select(*[c(x).cast("timestamp") if x == "ts" else c(x) for x in FILL_COLUMNS])
    micros = F.unix_micros("ts")
    low, high = fills.agg(F.min(micros), F.max(micros)).first()
    arrival = F.when(c("event_id") % 23 == 0, 3).otherwise(F.floor((micros - lit(low or 0)) * 4 / lit((high or 0) - (low or 0) + 1)))
    for i in range(4):
        fills.filter(arrival == i).write.mode("append").parquet(f"{folder}/in")
        out = streams.windows_and_late(v.spark.readStream.schema(fills.schema).parquet(f"{folder}/in"), folder)
    return out


ARRIVALS_SQL = """ar AS (SELECT f.*, CASE WHEN event_id % 23 = 0 THEN 3 ELSE floor((epoch_us(ts) - low) * 4 / (high - low + 1))::BIGINT END AS arrival FROM fills f CROSS JOIN (SELECT epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM fills)),
gr AS (SELECT a.arrival, max(b.ts) AS greatest FROM (SELECT DISTINCT arrival FROM ar) a JOIN ar b ON b.arrival < a.arrival GROUP BY 1),
sp AS (SELECT ar.*, coalesce(date_trunc('hour', ts) + INTERVAL 1 HOUR <= greatest - INTERVAL 10 MINUTE, false) AS late FROM ar LEFT JOIN gr ON ar.arrival = gr.arrival)"""


@query(
    "r01_stream_trade_metrics",
    f"WITH {ARRIVALS_SQL} SELECT date_trunc('hour', ts) AS start, symbol, count(*) AS trades, sum(quantity)::BIGINT AS volume, sum(CASE taker_side WHEN 'BUY' THEN quantity ELSE 0 END)::BIGINT AS buy_volume, round(sum(price * quantity) / sum(quantity), 6) AS vwap, arg_max(price, event_id) AS last_price "
    "FROM sp WHERE NOT late AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM fills) - INTERVAL 10 MINUTE GROUP BY 1, 2",
)
def r01(v):
    """Windows that are closed; late fills are in none."""
    return _arrived(v)[0].withColumn("vwap", F.round("vwap", 6))


@query("r01_late_fills", f"WITH {ARRIVALS_SQL} SELECT event_id, symbol FROM sp WHERE late")
def r01_late(v):
    """Late fills, kept apart."""
    return _arrived(v)[1].select("event_id", "symbol")


@query("r02_stream_running_totals", "SELECT event_id, symbol, count(*) OVER w AS total_trades, (sum(quantity) OVER w)::BIGINT AS total_volume FROM fills WINDOW w AS (PARTITION BY symbol ORDER BY time_ns, event_id ROWS UNBOUNDED PRECEDING)")
def r02(v):
    spark, path = v.spark, streams.shared_folder(v.spark, "stream")
    v.fills.select(*FILL_COLUMNS[:-2], "time_ns").write.parquet(f"{path}/in")
    fills = spark.readStream.schema("event_id bigint, symbol bigint, taker_side string, price double, quantity bigint, time_ns bigint").parquet(f"{path}/in")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, ROCKSDB)
    try:
        streams.append_to_table(streams.stream_running_totals(fills), path, "update")
    finally:
        spark.conf.set(store, before)
    return spark.read.schema(streams.TOTALS).parquet(f"{path}/result").drop("batch")
