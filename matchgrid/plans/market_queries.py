"""Queries L1-L9 and Q1-Q15."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.operators import checks as Q
from matchgrid.operators import orders as L
from matchgrid.operators import windows as W
from matchgrid.operators.ranges import as_of_join
from matchgrid.plans.registry import query

c, lit = F.col, F.lit

VALID_SQL = """vo AS (SELECT *, CASE WHEN time_ns < 0 THEN 'timestamp must not be negative' WHEN order_id = '' THEN 'order id must not be empty' WHEN action = 'NEW' AND upper(side) NOT IN ('BUY', 'BID', 'B', 'SELL', 'ASK', 'S') THEN 'unknown side'
  WHEN action IN ('NEW', 'AMEND') AND price <= 0 THEN 'price must be positive' WHEN action IN ('NEW', 'AMEND') AND quantity <= 0 THEN 'quantity must be positive' END AS error FROM order_events)"""


@query("l01_validate_orders", f"WITH {VALID_SQL} SELECT event_id, error FROM vo")
def l01(v):
    return L.validate_orders(v.order_events).select("event_id", "error")


@query("l02_normalise_side", "SELECT event_id, CASE WHEN upper(side) IN ('BUY', 'BID', 'B') THEN 'BUY' ELSE 'SELL' END AS side FROM order_events")
def l02(v):
    return v.order_events.select("event_id", L.normalise_side(c("side")).alias("side"))


L3_SQL = f"""{VALID_SQL}, ev AS (SELECT * FROM vo WHERE error IS NULL AND time_ns <= 8000000000000), fl AS (SELECT 'o' || (event_id - 3) AS order_id, sum(quantity // 4)::BIGINT AS filled FROM fills WHERE time_ns <= 8000000000000 GROUP BY 1),
l3 AS (SELECT b.order_id, symbol, side, price, quantity - coalesce(filled, 0) AS quantity, time_ns FROM (SELECT order_id, arg_max(price, event_id) FILTER (action IN ('NEW', 'AMEND')) AS price, arg_max(quantity, event_id) FILTER (action IN ('NEW', 'AMEND')) AS quantity,
  CASE WHEN upper(arg_min(side, event_id) FILTER (action = 'NEW')) IN ('BUY', 'BID', 'B') THEN 'BUY' ELSE 'SELL' END AS side, arg_min(symbol, event_id) FILTER (action = 'NEW') AS symbol, min(time_ns) FILTER (action = 'NEW') AS time_ns,
  count(*) FILTER (action = 'CANCEL') AS cancels, count(*) FILTER (action = 'NEW') AS news FROM ev GROUP BY order_id) b LEFT JOIN fl ON b.order_id = fl.order_id WHERE cancels = 0 AND news > 0 AND quantity - coalesce(filled, 0) > 0)"""


def l3(v):
    valid = L.validate_orders(v.order_events).filter("error is null")
    fills = v.fills.select(F.concat(lit("o"), (c("event_id") - 3).cast("string")).alias("order_id"), F.expr("quantity div 4").alias("quantity"), "time_ns")
    return L.resting_orders(valid, fills, as_of=8_000_000_000_000)


@query("l03_resting_orders", f"WITH {L3_SQL} SELECT order_id, symbol, side, price, quantity, time_ns FROM l3")
def l03(v):
    return l3(v).select("order_id", "symbol", "side", "price", "quantity", "time_ns")


L2_SQL = f"{L3_SQL}, l2 AS (SELECT symbol, side, price, sum(quantity)::BIGINT AS quantity, count(*) AS orders FROM l3 GROUP BY ALL)"


@query("l04_price_levels", f"WITH {L2_SQL} SELECT * FROM l2")
def l04(v):
    return L.price_levels(l3(v))


@query("t05_depth", f"WITH {L2_SQL} SELECT symbol, side, price, quantity, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE side WHEN 'BUY' THEN -price ELSE price END)::INTEGER AS level FROM l2 QUALIFY level <= 5")
def t05(v):
    return W.depth(L.price_levels(l3(v)), 5, ["symbol"]).drop("orders")


@query(
    "l05_top_of_book",
    f"WITH {L2_SQL}, l1 AS (SELECT symbol, max(price) FILTER (side = 'BUY') AS bid, arg_max(quantity, price) FILTER (side = 'BUY') AS bid_qty, min(price) FILTER (side = 'SELL') AS ask, arg_min(quantity, price) FILTER (side = 'SELL') AS ask_qty FROM l2 GROUP BY symbol) "
    "SELECT symbol, bid, bid_qty, ask, ask_qty, ask - bid AS spread, (bid + ask) / 2 AS mid, round((ask - bid) * 10000 / ((bid + ask) / 2), 6) AS spread_bps, round((bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty), 6) AS micro_price FROM l1",
)
def l05(v):
    return L.top_of_book(L.price_levels(l3(v))).withColumns({x: F.round(x, 6) for x in ("spread_bps", "micro_price")})


# -- the book over time: every tenth valid event of a symbol is a sample point ------------------


def _series_sql(n: int) -> str:
    """Books rebuilt for each sample point from all events and fills up to it."""
    return f"""{VALID_SQL}, ok AS (SELECT * FROM vo WHERE error IS NULL), sp AS (SELECT symbol, time_ns, row_number() OVER (PARTITION BY symbol ORDER BY time_ns) AS nth FROM (SELECT symbol, time_ns, row_number() OVER (PARTITION BY symbol ORDER BY time_ns, event_id) AS k FROM ok) WHERE k % {n} = 0),
ob AS (SELECT sp.symbol AS at_symbol, sp.time_ns AS at_ns, nth, order_id, arg_max(price, event_id) FILTER (action IN ('NEW', 'AMEND')) AS price, arg_max(quantity, event_id) FILTER (action IN ('NEW', 'AMEND')) AS quantity,
  CASE WHEN upper(arg_min(side, event_id) FILTER (action = 'NEW')) IN ('BUY', 'BID', 'B') THEN 'BUY' ELSE 'SELL' END AS side, arg_min(ok.symbol, event_id) FILTER (action = 'NEW') AS symbol, count(*) FILTER (action = 'CANCEL') AS cancels, count(*) FILTER (action = 'NEW') AS news
  FROM sp JOIN ok ON ok.time_ns <= sp.time_ns GROUP BY 1, 2, 3, 4), of AS (SELECT sp.symbol AS at_symbol, sp.time_ns AS at_ns, 'o' || (event_id - 3) AS order_id, sum(quantity // 4)::BIGINT AS filled FROM sp JOIN fills ON fills.time_ns <= sp.time_ns GROUP BY 1, 2, 3),
ol AS (SELECT at_symbol AS symbol, at_ns AS time_ns, nth, side, price, sum(quantity - coalesce(filled, 0))::BIGINT AS quantity, count(*) AS orders FROM ob LEFT JOIN of USING (at_symbol, at_ns, order_id) WHERE symbol = at_symbol AND cancels = 0 AND news > 0 AND quantity - coalesce(filled, 0) > 0 GROUP BY ALL),
tl AS (SELECT *, row_number() OVER (PARTITION BY symbol, nth, side ORDER BY CASE side WHEN 'BUY' THEN -price ELSE price END) AS level FROM ol QUALIFY level <= 10),
tb AS (SELECT symbol, nth, max(price) FILTER (side = 'BUY') AS bid, arg_max(quantity, price) FILTER (side = 'BUY') AS bid_qty, min(price) FILTER (side = 'SELL') AS ask, arg_min(quantity, price) FILTER (side = 'SELL') AS ask_qty,
  coalesce(sum(quantity) FILTER (side = 'BUY'), 0)::BIGINT AS bid_volume, coalesce(sum(quantity) FILTER (side = 'SELL'), 0)::BIGINT AS ask_volume, count(*) FILTER (side = 'BUY') AS bid_depth, count(*) FILTER (side = 'SELL') AS ask_depth,
  coalesce(sum(quantity) FILTER (side = 'BUY' AND level <= 5), 0)::DOUBLE AS bt, coalesce(sum(quantity) FILTER (side = 'SELL' AND level <= 5), 0)::DOUBLE AS at_ FROM tl GROUP BY symbol, nth),
se AS (SELECT sp.symbol, sp.nth, sp.time_ns, bid, bid_qty, ask, ask_qty, ask - bid AS spread, (bid + ask) / 2 AS mid, coalesce(bid_volume, 0) AS bid_volume, coalesce(ask_volume, 0) AS ask_volume, coalesce(bid_depth, 0) AS bid_depth, coalesce(ask_depth, 0) AS ask_depth,
  coalesce((bt - at_) / nullif(bt + at_, 0), 0) AS volume_imbalance FROM sp LEFT JOIN tb ON sp.symbol = tb.symbol AND sp.nth = tb.nth)"""


SERIES_SQL = _series_sql(10)


def series(v, n: int = 10):
    valid = L.validate_orders(v.order_events).filter("error is null")
    fills = v.fills.select(F.concat(lit("o"), (c("event_id") - 3).cast("string")).alias("order_id"), F.expr("quantity div 4").alias("quantity"), "time_ns")
    points = W.every_nth(valid.select("symbol", "time_ns", "event_id"), ["symbol"], ["time_ns", "event_id"], n)
    return L.book_series(valid, points, fills)


@query("l04_price_levels_series", f"WITH {SERIES_SQL} SELECT symbol, nth, time_ns, side, price, quantity, orders, level::INTEGER AS level FROM tl")
def l04_series(v):
    both = series(v).select("symbol", "nth", "time_ns", F.explode(F.array(F.struct(lit("BUY").alias("side"), c("bids").alias("levels")), F.struct(lit("SELL").alias("side"), c("asks").alias("levels")))).alias("s"))
    rows = both.select("symbol", "nth", "time_ns", "s.side", F.posexplode("s.levels").alias("level", "l"))
    return rows.select("symbol", "nth", "time_ns", "side", "l.price", "l.quantity", "l.orders", (c("level") + 1).alias("level"))


@query(
    "l05_top_of_book_series",
    f"WITH {SERIES_SQL} SELECT symbol, nth, time_ns, bid, bid_qty, ask, ask_qty, spread, mid, round(spread * 10000 / mid, 6) AS spread_bps, round((bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty), 6) AS micro_price FROM se",
)
def l05_series(v):
    return L.top_of_series(series(v)).withColumns({x: F.round(x, 6) for x in ("spread_bps", "micro_price")})


@query(
    "l07_market_metrics_series",
    f"WITH {SERIES_SQL} SELECT symbol, nth, time_ns, bid, ask, spread, mid, round(spread * 10000 / mid, 6) AS spread_bps, bid_volume, ask_volume, bid_depth::INTEGER AS bid_depth, ask_depth::INTEGER AS ask_depth, round(volume_imbalance, 9) AS volume_imbalance, round(avg(spread) OVER w, 6) AS rolling_spread, "
    "round(avg(volume_imbalance) OVER w, 9) AS rolling_imbalance FROM se WINDOW w AS (PARTITION BY symbol ORDER BY nth ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
)
def l07_series(v):
    return L.market_series(series(v)).withColumns({"spread_bps": F.round("spread_bps", 6), "rolling_spread": F.round("rolling_spread", 6), "volume_imbalance": F.round("volume_imbalance", 9), "rolling_imbalance": F.round("rolling_imbalance", 9)})


@query(
    "l06_slippage_to_mid",
    f"WITH {SERIES_SQL}, qt AS (SELECT symbol, time_ns, mid FROM se WHERE mid IS NOT NULL) SELECT event_id, mid, round((price - mid) / mid * CASE taker_side WHEN 'BUY' THEN 1 ELSE -1 END, 9) AS slippage FROM fills ASOF LEFT JOIN qt ON fills.symbol = qt.symbol AND fills.time_ns > qt.time_ns",
)
def l06_slippage(v):
    quotes = L.top_of_series(series(v)).select("symbol", "time_ns", "mid")
    return L.slippage(v.fills, quotes).select("event_id", "mid", F.round("slippage", 9).alias("slippage"))


@query("j14_events_as_of", "SELECT e.event_id, r.event_id AS seen_id, r.price AS seen_price FROM order_events e ASOF LEFT JOIN (SELECT event_id, symbol, price, time_ns FROM fills) r ON e.symbol = r.symbol AND e.time_ns >= r.time_ns")
def j14_as_of(v):
    seen = v.fills.select("symbol", "time_ns", c("event_id").alias("seen_id"), c("price").alias("seen_price"))
    return as_of_join(v.order_events, seen, ["symbol"], "time_ns", ["seen_id", "seen_price"]).select("event_id", "seen_id", "seen_price")


TRADES_SQL = "count(*) AS trades, count(*) FILTER (taker_side = 'BUY') AS buys, count(*) FILTER (taker_side = 'SELL') AS sells, sum(quantity)::BIGINT AS volume, coalesce(sum(quantity) FILTER (taker_side = 'BUY'), 0)::BIGINT AS buy_volume, coalesce(sum(quantity) FILTER (taker_side = 'SELL'), 0)::BIGINT AS sell_volume, round(sum(price * quantity) / sum(quantity), 6) AS vwap, arg_max(price, event_id) AS last_price"


@query("l06_trade_metrics", f"SELECT symbol, {TRADES_SQL}, round(avg((price - 10) / 10.0::DOUBLE * CASE taker_side WHEN 'BUY' THEN 1 ELSE -1 END), 6) AS mean_slippage FROM fills GROUP BY symbol")
def l06(v):
    return L.trade_metrics(v.fills, ref_price=lit(10.0)).withColumns({x: F.round(x, 6) for x in ("vwap", "mean_slippage")})


@query(
    "l07_market_metrics",
    f"WITH {L2_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE side WHEN 'BUY' THEN -price ELSE price END) AS lv FROM l2), ag AS (SELECT symbol, coalesce(sum(quantity) FILTER (side = 'BUY'), 0)::BIGINT AS bid_volume, coalesce(sum(quantity) FILTER (side = 'SELL'), 0)::BIGINT AS ask_volume, "
    "count(*) FILTER (side = 'BUY') AS bid_depth, count(*) FILTER (side = 'SELL') AS ask_depth, coalesce(sum(quantity) FILTER (side = 'BUY' AND lv <= 5), 0)::DOUBLE AS bt, coalesce(sum(quantity) FILTER (side = 'SELL' AND lv <= 5), 0)::DOUBLE AS at_, "
    "coalesce(sum(orders) FILTER (side = 'BUY'), 0)::BIGINT AS bid_orders, coalesce(sum(orders) FILTER (side = 'SELL'), 0)::BIGINT AS ask_orders FROM rk GROUP BY symbol) "
    "SELECT symbol, bid_volume, ask_volume, bid_depth, ask_depth, bid_orders, ask_orders, round(coalesce((bt - at_) / nullif(bt + at_, 0), 0), 9) AS volume_imbalance, round(coalesce((bid_orders - ask_orders)::DOUBLE / nullif(bid_orders + ask_orders, 0), 0), 9) AS order_imbalance FROM ag",
)
def l07(v):
    return L.market_metrics(L.price_levels(l3(v))).withColumns({x: F.round(x, 9) for x in ("volume_imbalance", "order_imbalance")})


@query(
    "l08_event_outcomes",
    f"WITH {VALID_SQL}, oc AS (SELECT *, coalesce(error, CASE WHEN action = 'CANCEL' AND order_id NOT IN (SELECT order_id FROM order_events WHERE action = 'NEW') THEN '' END) AS outcome FROM vo) "
    "SELECT symbol, count(*) AS total, count(*) FILTER (outcome IS NULL) AS ok, count(*) FILTER (outcome = '') AS failed, count(*) FILTER (outcome <> '') AS validation_errors FROM oc GROUP BY symbol",
)
def l08(v):
    """A cancel of an order that never was fails without a message."""
    known = v.order_events.filter("action = 'NEW'").select("order_id").distinct().withColumn("known", lit(True))
    events = L.validate_orders(v.order_events).join(known, "order_id", "left")
    unknown = (c("action") == "CANCEL") & c("known").isNull()
    return L.event_outcome_summary(events.withColumn("error", F.coalesce("error", F.when(unknown, ""))), ["symbol"])


@query(
    "l09_metrics_summary",
    "SELECT symbol, arg_max(price, event_id) AS last_price, round(arg_max(mp, event_id), 6) AS mean_price, round(arg_max((b - s)::DOUBLE / nullif(b + s, 0), event_id), 9) AS flow_imbalance, count(*) AS total_trades, sum(quantity)::BIGINT AS total_volume FROM "
    "(SELECT *, avg(price) OVER w AS mp, sum(CASE taker_side WHEN 'BUY' THEN quantity ELSE 0 END) OVER w AS b, sum(CASE taker_side WHEN 'SELL' THEN quantity ELSE 0 END) OVER w AS s FROM fills WINDOW w AS (PARTITION BY symbol ORDER BY time_ns, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) GROUP BY symbol",
)
def l09(v):
    order = ["time_ns", "event_id"]
    rolled = W.rolling_flow_imbalance(W.rolling_mean(v.fills, ["symbol"], order, "price", 20, "mean_price"), ["symbol"], order, 20)
    return L.metrics_summary(rolled).withColumns({"mean_price": F.round("mean_price", 6), "flow_imbalance": F.round("flow_imbalance", 9)})


# -- data quality ------------------------------------------------------------------------------


def one(check, bad, source):
    return f"SELECT '{check}' AS \"check\", n = 0 AS ok, n::VARCHAR AS detail FROM (SELECT coalesce({bad}, 0)::BIGINT AS n FROM {source})"


@query(
    "q01_schema",
    "WITH t AS (SELECT column_name AS c, column_type AS d FROM (DESCRIBE SELECT * FROM lineitem)) SELECT 'lineitem' AS file, 'l_weight' AS \"column\", 'missing' AS problem WHERE 'l_weight' NOT IN (SELECT c FROM t) UNION ALL SELECT 'lineitem', c, 'extra' FROM t WHERE c NOT IN ('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_discount', 'l_shipdate', 'l_weight') "
    "UNION ALL SELECT 'lineitem', c, 'type ' || lower(d) || ' for int' FROM t WHERE c = 'l_orderkey' AND d <> 'INTEGER'",
)
def q01(v):
    """Footers of all files of lineitem against a target that differs in some columns."""
    have = v.lineitem.schema
    want = T.StructType([T.StructField("l_orderkey", T.IntegerType()), *[have[x] for x in ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate")], T.StructField("l_weight", T.DoubleType())])
    found = Q.check_file_schemas(v.spark, [f"{v.sf_dir}/lineitem.parquet"], want)
    return found.withColumn("file", F.regexp_extract("file", r"([^/]+)\.parquet(/|$)", 1))


@query("q01_schema_of_table")
def q01_table(v):
    """Names, order, count and types of a table as Spark sees it; DuckDB has other names for types."""
    want = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.LongType()), T.StructField("n_comment", T.StringType())])
    return Q.check_schema(v.nation, want)


@query("q02_no_new_nulls", one("no_new_nulls", "count(*) FILTER (o IS NOT NULL AND n IS NULL)", "(SELECT p_size AS o, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS n FROM part)"))
def q02(v):
    text = F.when(c("p_partkey") % 4 == 0, "tall").otherwise(c("p_size").cast("string"))
    return Q.check_no_new_nulls(v.part.select("p_size", text.try_cast("int").alias("parsed")), "p_size", "parsed")


@query("q03_range", one("range_height_cm", "count(*) FILTER (height_cm NOT BETWEEN 155 AND 205)", "player_season_raw"))
def q03(v):
    return Q.check_range(v.player_season_raw, "height_cm", 155, 205)


@query("q04_duplicates", one("duplicates", "sum(k - 1)", "(SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber)"))
def q04(v):
    return Q.check_duplicates(v.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "q05_sums_preserved",
    " UNION ALL ".join(f"SELECT 'sum_{x}' AS \"check\", abs(a - b) <= 1e-6 * greatest(abs(a), 1) AS ok FROM (SELECT coalesce(sum({x}), 0) AS a FROM player_season_raw) CROSS JOIN (SELECT coalesce(sum({x}), 0) AS b FROM player_season)" for x in ("goals", "minutes", "assists")),
)
def q05(v):
    return Q.check_sums_preserved(v.player_season_raw, v.player_season, ["goals", "minutes", "assists"])


@query("q06_expected_counts", "SELECT season, count(DISTINCT home_team_id) AS n, count(DISTINCT home_team_id) = 25 AS ok FROM matches GROUP BY season")
def q06(v):
    return Q.check_expected_counts(v.matches, ["season"], 25, "home_team_id")


@query(
    "q07_pairing",
    "SELECT count(*) FILTER (nb IS NULL) AS only_a, count(*) FILTER (na IS NULL) AS only_b, count(*) FILTER (na > 1 OR nb > 1) AS repeated FROM (SELECT fixture_id, count(*) AS na FROM matches WHERE fixture_id % 3 > 0 GROUP BY 1) a FULL JOIN (SELECT fixture_id, count(*) AS nb FROM lineups WHERE fixture_id % 5 > 0 GROUP BY 1) b USING (fixture_id)",
)
def q07(v):
    return Q.check_pairing(v.matches.filter("fixture_id % 3 > 0"), v.lineups.filter("fixture_id % 5 > 0"), ["fixture_id"])


@query("q08_coverage", "SELECT count(*) AS n, count(l.fixture_id) AS covered, round(count(l.fixture_id) * 100.0::DOUBLE / count(*), 6) AS pct, count(l.fixture_id) * 100.0::DOUBLE / count(*) >= 90 AS ok FROM (SELECT DISTINCT fixture_id FROM matches) m LEFT JOIN (SELECT DISTINCT fixture_id FROM lineups) l ON m.fixture_id = l.fixture_id")
def q08(v):
    return Q.check_coverage(v.matches, v.lineups, "fixture_id", 90.0).withColumn("pct", F.round("pct", 6))


@query("q09_constant", one("constant_team_name", "count(*) FILTER (k > 1)", "(SELECT count(DISTINCT team_name) AS k FROM lineups GROUP BY team_id)"))
def q09(v):
    return Q.check_constant(v.lineups, "team_id", "team_name")


@query(
    "q10_inner_gap",
    "SELECT player_id, unnest(list_filter([1996, 1997, 1998, 1999], lambda y: NOT list_contains(seen, y)))::INTEGER AS missing FROM (SELECT player_id, list(DISTINCT season) AS seen FROM player_season_raw GROUP BY player_id HAVING min(season) < 1996 AND max(season) > 1999)",
)
def q10(v):
    return Q.check_inner_gap(v.player_season_raw, "player_id", "season", 1996, 1999).select("player_id", F.explode("missing").alias("missing"))


@query(
    "q11_parts_total",
    "SELECT whole, parts, whole = parts AS ok FROM (SELECT count(*) AS whole FROM lineitem) CROSS JOIN (SELECT sum(n)::BIGINT AS parts FROM (SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT count(*) FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT count(*) FROM lineitem WHERE l_returnflag = 'R'))",
)
def q11(v):
    return Q.check_parts_total(v.lineitem, *[v.lineitem.filter(c("l_returnflag") == x) for x in ("A", "N", "R")])


@query("q12_single_parent", "SELECT player_id, string_agg(DISTINCT team_id::VARCHAR, ',' ORDER BY team_id::VARCHAR) AS parents FROM lineups GROUP BY player_id HAVING count(DISTINCT team_id) > 1")
def q12(v):
    out = Q.check_single_parent(v.lineups.withColumn("team", c("team_id").cast("string")), "player_id", "team")
    return out.select("player_id", F.array_join("parents", ",").alias("parents"))


@query("q13_required", "SELECT team_id, count(*) AS n, count(*) FILTER (number IS NULL) AS empty_number, count(*) FILTER (player_name = '') AS empty_player_name, count(*) >= 4 AND count(*) FILTER (number IS NULL OR player_name = '') = 0 AS ok FROM (SELECT team_id, number, CASE WHEN player_id % 7 = 0 THEN '' ELSE player_name END AS player_name FROM squads) GROUP BY team_id")
def q13(v):
    named = v.squads.withColumn("player_name", F.when(c("player_id") % 7 == 0, "").otherwise(c("player_name")))
    return Q.check_required(named, "team_id", ["number", "player_name"], 4)


@query(
    "q14_bounds",
    "SELECT player_id, batch_id, row_no, 'rating' AS rule FROM player_season_raw WHERE rating > 8 UNION ALL SELECT player_id, batch_id, row_no, 'accuracy' FROM player_season_raw WHERE passes_accuracy > 90",
)
def q14(v):
    rules = {"rating": c("rating").between(0, 8), "accuracy": c("passes_accuracy").between(0, 90)}
    return Q.check_bounds(v.player_season_raw, rules, ["player_id", "batch_id", "row_no"])


@query("q15_missing_scores", one("missing_halftime_home", "count(*) FILTER (halftime_home IS NULL)", "matches"))
def q15(v):
    return Q.check_missing(v.matches, "halftime_home")
