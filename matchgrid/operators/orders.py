"""Order events and fills as tables: books at three levels, market and trade metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.operators.lineage import checkpointed
from matchgrid.operators.ranges import ROWS, as_of_join, rolling, running

SIDES = ("BUY", "BID", "B", "SELL", "ASK", "S")


def normalise_side(side: Column) -> Column:
    """BUY, BID or B in any case is BUY, all else SELL."""
    return F.when(F.upper(side).isin("BUY", "BID", "B"), "BUY").otherwise("SELL")


def validate_orders(events: DataFrame) -> DataFrame:
    """``error``: the first rule that an event breaks, or null."""
    c = F.col
    new, amend = c("action") == "NEW", c("action") == "AMEND"
    error = (
        F.when(c("time_ns").isNull() | (c("time_ns") < 0), "timestamp must not be negative")
        .when(c("order_id").isNull() | (c("order_id") == ""), "order id must not be empty")
        .when(new & ~F.coalesce(F.upper("side").isin(*SIDES), F.lit(False)), "unknown side")
        .when((new & c("price").isNull()) | ((new | amend) & (c("price") <= 0)), "price must be positive")
        .when((new & c("quantity").isNull()) | ((new | amend) & (c("quantity") <= 0)), "quantity must be positive")
        .when(amend & c("price").isNull() & c("quantity").isNull(), "nothing to amend")
    )
    return events.withColumn("error", error)


def resting_orders(events: DataFrame, fills: DataFrame | None = None, as_of: int | None = None) -> DataFrame:
    """Orders that rest in the book: newest price and quantity, less what was filled, not cancelled.

    ``fills``: (order_id, quantity, time_ns). One grouping by order and one left join.
    """
    if as_of is not None:
        events = events.filter(F.col("time_ns") <= as_of)
        fills = fills.filter(F.col("time_ns") <= as_of) if fills is not None else None
    at = F.struct("time_ns", "event_id")
    live = F.col("action").isin("NEW", "AMEND")
    book = events.groupBy("order_id").agg(
        F.max_by("price", F.when(live & F.col("price").isNotNull(), at)).alias("price"),
        F.max_by("quantity", F.when(live & F.col("quantity").isNotNull(), at)).alias("quantity"),
        F.min_by("side", F.when(F.col("action") == "NEW", at)).alias("side"),
        F.min_by("symbol", F.when(F.col("action") == "NEW", at)).alias("symbol"),
        F.min(F.when(F.col("action") == "NEW", F.col("time_ns"))).alias("time_ns"),
        F.count_if(F.col("action") == "CANCEL").alias("cancels"),
    )
    book = book.filter("cancels = 0 and side is not null").drop("cancels").withColumn("side", normalise_side(F.col("side")))
    if fills is not None:
        done = fills.groupBy("order_id").agg(F.sum("quantity").alias("filled"))
        book = book.join(done, "order_id", "left").withColumn("quantity", F.col("quantity") - F.coalesce("filled", F.lit(0))).drop("filled")
    return book.filter("quantity > 0")


def price_levels(l3: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return l3.groupBy(*keys, "side", "price").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("orders"))


def top_of_book(l2: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Best bid and ask with spread, mid and micro-price; null where a side is missing."""
    bid, ask = F.when(F.col("side") == "BUY", F.col("price")), F.when(F.col("side") == "SELL", F.col("price"))
    out = l2.groupBy(*keys).agg(F.max(bid).alias("bid"), F.max_by("quantity", bid).alias("bid_qty"), F.min(ask).alias("ask"), F.min_by("quantity", ask).alias("ask_qty"))
    b, a, bq, aq = (F.col(x) for x in ("bid", "ask", "bid_qty", "ask_qty"))
    mid = (b + a) / 2.0
    return out.withColumns({"spread": a - b, "mid": mid, "spread_bps": F.try_divide((a - b) * 10000.0, mid), "micro_price": F.try_divide(b * aq + a * bq, (bq + aq).cast("double"))})


def trade_metrics(fills: DataFrame, keys: Sequence[str] = ("symbol",), ref_price: Column | None = None) -> DataFrame:
    """Counts and volumes by taker side, VWAP, last price and mean relative slippage."""
    buy, sell = F.col("taker_side") == "BUY", F.col("taker_side") == "SELL"
    q, p = F.col("quantity"), F.col("price")
    slip = F.lit(None).cast("double") if ref_price is None else F.try_divide(p - ref_price, ref_price) * F.when(buy, 1.0).otherwise(-1.0)
    return fills.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        F.count_if(buy).alias("buys"),
        F.count_if(sell).alias("sells"),
        F.coalesce(F.sum(q), F.lit(0)).alias("volume"),
        F.coalesce(F.sum(F.when(buy, q)), F.lit(0)).alias("buy_volume"),
        F.coalesce(F.sum(F.when(sell, q)), F.lit(0)).alias("sell_volume"),
        F.try_divide(F.sum(p * q), F.sum(q).cast("double")).alias("vwap"),
        F.max_by("price", F.struct("time_ns", "event_id")).alias("last_price"),
        F.avg(slip).alias("mean_slippage"),
    )


def market_metrics(l2: DataFrame, keys: Sequence[str] = ("symbol",), top: int = 5) -> DataFrame:
    """Volumes and depth over all levels, imbalance of volume over the ``top`` best, and of orders.

    An imbalance without volume is 0.
    """
    best = F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price"))
    ranked = l2.withColumn("level", F.row_number().over(Window.partitionBy(*keys, "side").orderBy(best)))
    buy, near = F.col("side") == "BUY", F.col("level") <= top

    def total(column: str, *conditions: Column) -> Column:
        cond = conditions[0]
        for x in conditions[1:]:
            cond = cond & x
        return F.coalesce(F.sum(F.when(cond, F.col(column))), F.lit(0))

    out = ranked.groupBy(*keys).agg(
        total("quantity", buy).alias("bid_volume"),
        total("quantity", ~buy).alias("ask_volume"),
        F.count_if(buy).alias("bid_depth"),
        F.count_if(~buy).alias("ask_depth"),
        total("quantity", buy, near).alias("bid_top"),
        total("quantity", ~buy, near).alias("ask_top"),
        total("orders", buy).alias("bid_orders"),
        total("orders", ~buy).alias("ask_orders"),
    )

    def imbalance(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide((F.col(a) - F.col(b)).cast("double"), (F.col(a) + F.col(b)).cast("double")), F.lit(0.0))

    return out.withColumns({"volume_imbalance": imbalance("bid_top", "ask_top"), "order_imbalance": imbalance("bid_orders", "ask_orders")}).drop("bid_top", "ask_top")


def event_outcome_summary(validated: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Events in all, valid, and by error; an event that failed with a message is a validation error."""
    bad = F.col("error").isNotNull()
    return validated.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(~bad).alias("ok"), F.count_if(bad & (F.col("error") == "")).alias("failed"), F.count_if(bad & (F.col("error") != "")).alias("validation_errors"))


def metrics_summary(fills_with_rolling: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The last row of each symbol's rolling values beside its totals."""
    last = F.struct("time_ns", "event_id")
    return fills_with_rolling.groupBy(*keys).agg(
        F.max_by("price", last).alias("last_price"), F.max_by("mean_price", last).alias("mean_price"), F.max_by("flow_imbalance", last).alias("flow_imbalance"), F.count("*").alias("total_trades"), F.sum("quantity").alias("total_volume")
    )


# -- the book over time ------------------------------------------------------------------------
# A book at many times is swept once: orders become states with a beginning, states become changes
# of price levels, and what holds at a sample point is found from the stretches of points that a
# level's quantity lasts for. Nothing is rebuilt for each point, and no level is repeated for each
# point that it lasts for.


def order_changes(events: DataFrame, fills: DataFrame | None = None) -> DataFrame:
    """(symbol, side, price, time_ns, quantity, orders): what each event and fill adds to or takes
    from a price level, so that sums up to a time are the resting orders of that time.

    ``fills``: (order_id, quantity, time_ns). A window over the events of an order, which are few.
    """
    c, none = F.col, F.lit(None)
    live, new = c("action").isin("NEW", "AMEND"), c("action") == "NEW"
    changes = events.select(
        "order_id", "time_ns", "event_id", F.when(live, c("price")).alias("new_price"), F.when(live, c("quantity")).alias("new_quantity"), F.when(new, normalise_side(c("side"))).alias("new_side"),
        F.when(new, c("symbol")).alias("new_symbol"), (c("action") == "CANCEL").alias("cancels"), F.lit(0).cast("long").alias("filled"),
    )
    if fills is not None:
        empty = [none.cast(changes.schema[x].dataType).alias(x) for x in ("event_id", "new_price", "new_quantity", "new_side", "new_symbol")]
        changes = changes.unionByName(fills.select("order_id", "time_ns", *empty, F.lit(False).alias("cancels"), c("quantity").cast("long").alias("filled")))
    ordered = Window.partitionBy("order_id").orderBy("time_ns", "event_id")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    newest = {x: F.last(f"new_{x}", ignorenulls=True).over(so_far) for x in ("price", "quantity")}
    first = {x: F.first(f"new_{x}", ignorenulls=True).over(so_far) for x in ("side", "symbol")}
    states = changes.select("order_id", "time_ns", "event_id", *[x.alias(name) for name, x in (newest | first).items()], F.max("cancels").over(so_far).alias("cancelled"), F.sum("filled").over(so_far).alias("filled"))
    left = F.when(~c("cancelled") & c("side").isNotNull() & c("quantity").isNotNull(), F.greatest(c("quantity") - c("filled"), F.lit(0))).otherwise(0)
    states = states.withColumn("quantity", left.cast("long"))
    level = F.struct("symbol", "side", "price", "quantity")
    states = states.select("time_ns", level.alias("now"), F.lag(level).over(ordered).alias("was"))
    part = lambda s, sign: F.struct(s["symbol"].alias("symbol"), s["side"].alias("side"), s["price"].alias("price"), (s["quantity"] * sign).alias("quantity"), F.lit(sign).cast("long").alias("orders"))
    both = F.filter(F.array(part(c("was"), -1), part(c("now"), 1)), lambda p: p["quantity"] != 0)
    return states.filter(~c("now").eqNullSafe(c("was"))).select("time_ns", F.explode(both).alias("_part")).select("_part.symbol", "_part.side", "_part.price", "time_ns", "_part.quantity", "_part.orders")


def _at_points(changes: DataFrame, points: DataFrame, before: bool, rows: int) -> DataFrame:
    """Changes with ``since``, the number (from 0) of the symbol's first sample point that they hold at.

    With ``before`` they hold after their own time only. Changes that hold at no point are dropped.
    """
    tagged = changes.withColumn("_side", F.lit(1 if before else 0)).withColumn("_point", F.lit(0))
    marks = points.select("symbol", "time_ns", F.lit(0 if before else 1).alias("_side"), F.lit(1).alias("_point"))
    counted = running(tagged.unionByName(marks, allowMissingColumns=True), ["symbol"], ["time_ns", "_side"], {"since": ("sum", F.col("_point"))}, rows)
    return counted.filter("_point = 0").select(*changes.columns, "since")


def level_stretches(changes: DataFrame, points: DataFrame, before: bool = False, rows: int = ROWS) -> DataFrame:
    """(symbol, side, price, quantity, orders, since, till): what each price level holds at the sample
    points from number ``since`` to before ``till``; ``points``: (symbol, time_ns), no two alike."""
    key = ["symbol", "side", "price"]
    ends = points.groupBy(F.col("symbol").alias("_of")).agg(F.count("*").alias("_points"))
    # ranges are found in several passes over what they cut, which must not make it anew each time
    changes = checkpointed(changes)
    steps = checkpointed(_at_points(changes, points, before, rows).groupBy(*key, "since").agg(F.sum("quantity").alias("d_quantity"), F.sum("orders").alias("d_orders")))
    levels = checkpointed(running(steps, key, ["since"], {"quantity": ("sum", F.col("d_quantity")), "orders": ("sum", F.col("d_orders"))}, rows).select(*key, "since", "quantity", "orders"))
    state = F.struct("since", "quantity", "orders")
    # each row closes the stretch of the row before; the last one of a level is open to the end
    closed = rolling(levels, key, ["since"], 2, lambda w: {"_was": F.lag(state).over(w)}, rows).filter("_was is not null").select(*key, F.col("_was.quantity").alias("quantity"), F.col("_was.orders").alias("orders"), F.col("_was.since").alias("since"), F.col("since").alias("till"))
    last = levels.groupBy(*key).agg(F.max_by(state, "since").alias("_last")).join(ends, F.col("symbol").eqNullSafe(F.col("_of"))).select(*key, "_last.quantity", "_last.orders", "_last.since", F.col("_points").alias("till"))
    return closed.unionByName(last).filter("quantity > 0 and since < till")


def _spans(stretches: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """``columns`` of each stretch beside the aligned spans (level, number) of [since, till): 2**level
    points from number * 2**level on.

    At each level at most one span at either end is left over by the level above, so a stretch of n
    points has about 2 log n spans. Levels are rows, so that all of it is plain generated code.
    """
    top = F.ceil(F.log2((F.col("till") - F.col("since") + 1).cast("double"))).cast("int")
    rows = stretches.select(*columns, "since", "till", F.explode(F.sequence(F.lit(0), top)).alias("level"))
    shift = lambda way, x: F.call_function(f"shift{way}", x, F.col("level"))
    low, high = shift("right", F.col("since") + shift("left", F.lit(1).cast("long")) - 1), shift("right", F.col("till"))
    rows = rows.withColumns({"_low": low, "_high": high}).filter("_low < _high")
    ends = F.array(F.when(F.col("_low") % 2 == 1, F.col("_low")), F.when(F.col("_high") % 2 == 1, F.col("_high") - 1))
    return rows.withColumn("number", F.explode(ends)).filter("number is not null").drop("since", "till", "_low", "_high")


def best_levels(stretches: DataFrame, points: DataFrame, top: int, rows: int = ROWS) -> DataFrame:
    """(symbol, nth, time_ns, bids, asks): the ``top`` best levels at each sample point, best first.

    A stretch is cut into aligned spans of points, a span keeps its best levels, and a point takes
    the best of the spans that it lies in, of which there is one of each size: stretches and points
    cost a logarithm each instead of meeting one by one.
    """
    numbered = running(points.select("symbol", "time_ns"), ["symbol"], ["time_ns"], {"nth": ("sum", F.lit(1))}, rows).withColumn("_at", F.col("nth") - 1)
    best = F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price"))
    level = F.struct(best.alias("rank"), "price", "quantity", "orders").alias("_best")
    spans = _spans(stretches, ["symbol", "side", level])
    kept = spans.withColumn("_r", F.row_number().over(Window.partitionBy("symbol", "side", "level", "number").orderBy("_best.rank"))).filter(F.col("_r") <= top)
    kept = kept.groupBy("symbol", "level", "number").agg(*[F.collect_list(F.when(F.col("side") == side, F.col("_best"))).alias(side) for side in ("BUY", "SELL")])
    most = numbered.agg(F.max("nth")).first()[0] or 1
    at_span = F.floor(F.col("_at") / F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))).cast("long")
    spread = numbered.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(int(most).bit_length())))).withColumn("number", at_span)
    met = spread.join(kept, ["symbol", "level", "number"], "left").groupBy("symbol", "nth", "time_ns").agg(*[F.slice(F.array_sort(F.flatten(F.collect_list(side))), 1, top).alias(name) for side, name in (("BUY", "bids"), ("SELL", "asks"))])
    plain = lambda name: F.transform(name, lambda x: x.dropFields("rank")).alias(name)
    return met.select("symbol", "nth", "time_ns", plain("bids"), plain("asks"))


def book_series(events: DataFrame, points: DataFrame, fills: DataFrame | None = None, top: int = 10, before: bool = False, rows: int = ROWS) -> DataFrame:
    """The book of each symbol at each sample point: its ``top`` best levels of both sides.

    ``events`` are valid ones, ``points`` (symbol, time_ns). A point sees all events up to its
    time, or before it with ``before``. Points of equal time are one. nth counts a symbol's points from 1.
    """
    points = checkpointed(points.select("symbol", "time_ns").distinct())
    return best_levels(level_stretches(order_changes(events, fills), points, before, rows), points, top, rows)


def top_of_series(series: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """Best bid and ask at each point with spread, mid and micro-price; null where a side is missing.
    ``more``: further columns of the series."""
    first = lambda side, field: F.get(side, F.lit(0))[field]
    b, bq, a, aq = first("bids", "price"), first("bids", "quantity"), first("asks", "price"), first("asks", "quantity")
    mid = (b + a) / 2.0
    out = {"bid": b, "bid_qty": bq, "ask": a, "ask_qty": aq, "spread": a - b, "mid": mid, "spread_bps": F.try_divide((a - b) * 10000.0, mid), "micro_price": F.try_divide(b * aq + a * bq, (bq + aq).cast("double"))}
    return series.select("symbol", "nth", "time_ns", *[x.alias(name) for name, x in (out | (more or {})).items()])


def market_series(series: DataFrame, near: int = 5, window: int = 20, rows: int = ROWS) -> DataFrame:
    """Market metrics of each sample point over the levels given, and their means over the last points.

    Volumes and depth over all given levels, imbalance over the ``near`` best (0 without volume);
    rolling means pass over points without a spread.
    """
    volume = lambda levels: F.aggregate(levels, F.lit(0).cast("long"), lambda t, x: t + x["quantity"])
    bids, asks = volume(F.slice("bids", 1, near)), volume(F.slice("asks", 1, near))
    own = {
        "bid_volume": volume(F.col("bids")), "ask_volume": volume(F.col("asks")), "bid_depth": F.size("bids"), "ask_depth": F.size("asks"),
        "volume_imbalance": F.coalesce(F.try_divide((bids - asks).cast("double"), (bids + asks).cast("double")), F.lit(0.0)),
    }
    out = top_of_series(series, own).drop("bid_qty", "ask_qty", "micro_price")
    means = {"rolling_spread": "spread", "rolling_imbalance": "volume_imbalance"}
    return rolling(checkpointed(out), ["symbol"], ["nth"], window, lambda w: {name: F.avg(x).over(w.rowsBetween(1 - window, 0)) for name, x in means.items()}, rows)


def slippage(fills: DataFrame, quotes: DataFrame, rows: int = ROWS) -> DataFrame:
    """Fills with the last mid quoted before them and their relative slippage against it, positive
    where the taker did worse; null without a mid."""
    known = checkpointed(quotes.filter("mid is not null").select("symbol", "time_ns", "mid"))
    met = as_of_join(fills, known, ["symbol"], "time_ns", ["mid"], before=True, rows=rows)
    return met.withColumn("slippage", F.try_divide(F.col("price") - F.col("mid"), F.col("mid")) * F.when(F.col("taker_side") == "BUY", 1.0).otherwise(-1.0))
