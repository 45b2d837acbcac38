"""Windows over hot keys: cut into ranges they give what one window gives."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchgrid.operators import orders as O
from matchgrid.operators import ranges as R
from matchgrid.operators import windows as W


def rows(rng, n, keys=("a",), times=None):
    out = []
    for i in range(n):
        t = rng.choice(times) if times else rng.randrange(10**6)
        out.append((rng.choice(keys), t, i, rng.choice([None, 1.0, 2.5, -3.0, 0.125]), rng.choice(["BUY", "SELL"]), rng.randrange(1, 50)))
    return out


SCHEMA = "symbol string, time_ns long, event_id long, price double, taker_side string, quantity long"
ORDER = ["time_ns", "event_id"]
CASES = {
    "one key": dict(n=900),
    "hot and small keys": dict(n=900, keys=("a", "a", "a", "a", "b", None, "c")),
    "all at one time": dict(n=700, times=[5]),
    "a burst and a far end": dict(n=900, times=[0, 10**15] + [7] * 50 + list(range(100, 120))),
    "null times": dict(n=500, times=[None, None, 3, 4, 5, 6]),
    "no rows": dict(n=0),
}


@pytest.fixture(params=sorted(CASES))
def fills(spark, request):
    return spark.createDataFrame(rows(random.Random(request.param), **CASES[request.param]), SCHEMA).repartition(5)


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    a = sorted(map(tuple, got.select(*want.columns).collect()), key=repr)
    b = sorted(map(tuple, want.collect()), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9)) for p, q in zip(x, y, strict=True)), (x, y)


def test_ranges_are_even_and_in_order(fills):
    cut = R.Cut(fills, ["symbol"], ORDER, rows=50)
    found = cut.df.groupBy("symbol", R.RANGE).agg(F.count("*").alias("n"), F.min(F.struct(*ORDER)).alias("low"), F.max(F.struct(*ORDER)).alias("high")).collect()
    sizes = {r["symbol"]: r["n"] for r in fills.groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    for key, n in sizes.items():
        own = sorted((r for r in found if r["symbol"] == key), key=lambda r: r[R.RANGE])
        assert sum(r["n"] for r in own) == n
        if n <= 50:
            assert [r[R.RANGE] for r in own] == [-1]
            continue
        assert all(r[R.RANGE] >= 0 and r["n"] <= 150 for r in own) and all(r["n"] >= 50 for r in own[:-1])
        assert len(own) >= n / 150
        first = lambda x: tuple((v is not None, v or 0) for v in x)
        assert all(first(a["high"]) < first(b["low"]) for a, b in zip(own, own[1:]))
    assert cut.ranges == len({r[R.RANGE] for r in found} - {-1})


def test_running_values(fills):
    values = {"n": ("sum", F.lit(1)), "s": ("sum", F.col("price")), "m": ("max", F.col("price")), "l": ("last", F.col("price")), "p": ("product", F.lit(1.0) + F.col("price") / 100)}
    w = Window.partitionBy("symbol").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    want = fills.withColumns({"n": F.sum(F.lit(1)).over(w), "s": F.sum("price").over(w), "m": F.max("price").over(w), "l": F.last("price", True).over(w), "p": F.product(F.lit(1.0) + F.col("price") / 100).over(w)})
    same(R.running(fills, ["symbol"], ORDER, values, rows=40), want)
    same(R.running(fills, ["symbol"], ORDER, values), want)


@pytest.mark.parametrize("n", [2, 100])
def test_rolling_values(fills, n):
    w = Window.partitionBy("symbol").orderBy(*ORDER)
    values = lambda w: {"mean": F.avg("price").over(w.rowsBetween(1 - n, 0)), "n": F.count("*").over(w.rowsBetween(1 - n, 0))}
    same(R.rolling(fills, ["symbol"], ORDER, n, values, rows=30), fills.withColumns(values(w)))


def test_compounded_paths(fills):
    bets = fills.filter("price is not null")
    factor = F.lit(1.0) + F.col("price") / 50
    w = Window.partitionBy("symbol").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    want = bets.withColumn("bankroll", F.lit(1000.0) * F.product(factor).over(w))
    want = want.withColumn("peak", F.greatest(F.max("bankroll").over(w), F.lit(1000.0)))
    same(R.compound(bets, ["symbol"], ORDER, factor, 1000.0, rows=40), want)


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("size", [40, 10**6])
def test_as_of_join(spark, before, size):
    rng = random.Random(7)
    left = rows(rng, 400, ("a", "a", "a", "b", None, "z"), [*range(60), None])
    right = [(k, t, i, p) for k, t, i, p, _, _ in rows(rng, 300, ("a", "a", "a", "b", None, "y"), [*range(0, 60, 3), None])]
    quotes = spark.createDataFrame(right, "symbol string, time_ns long, quote_id long, mid double")
    got = R.as_of_join(spark.createDataFrame(left, SCHEMA), quotes, ["symbol"], "time_ns", ["mid", "quote_id"], ["quote_id"], before, size)
    assert got.columns == [*SCHEMA.replace(",", "").split()[::2], "mid", "quote_id"]
    want = []
    for r in left:
        ok = [q for q in right if q[0] == r[0] and None not in (q[1], r[1]) and (q[1] < r[1] if before else q[1] <= r[1])]
        best = max(ok, key=lambda q: (q[1], q[2]), default=(None,) * 4)
        want.append((*r, best[3], best[2]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_order_columns_of_other_kinds(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = [(1, t0 + dt.timedelta(seconds=i % 97), dt.date(2024, 1, 1) + dt.timedelta(days=i % 7), float(i) if i % 11 else math.inf if i % 2 else -math.inf, i) for i in range(400)]
    df = spark.createDataFrame(data + [(1, None, None, None, 400), (1, t0, dt.date(2024, 1, 1), math.nan, 401)], "k int, ts timestamp, day date, x double, i int")
    for order in (["ts", "i"], ["day", "x", "i"], ["x", "i"]):
        w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        got = {r["i"]: r["n"] for r in R.running(df, ["k"], order, {"n": ("sum", F.lit(1))}, rows=20).collect()}
        assert got == {r["i"]: r["n"] for r in df.withColumn("n", F.count("*").over(w)).collect()}
    with pytest.raises(ValueError, match="order columns"):
        R.Cut(df.withColumn("t", F.lit("x")), ["k"], ["t"])


def test_tasks_grow_with_the_rows_of_one_key(spark):
    """Each task of the window holds few of the rows, though all have one key."""
    df = spark.range(0, 4000).select(F.lit("a").alias("symbol"), F.col("id").alias("time_ns"), F.col("id").alias("event_id"), F.lit("BUY").alias("taker_side"), F.lit(1.0).alias("price"), F.lit(2).alias("quantity"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = W.rolling_mean(df, ["symbol"], ORDER, "price", 5, "m", rows=100).withColumn("task", F.spark_partition_id())
        assert out.groupBy("task").count().agg(F.max("count")).first()[0] <= 2000 and out.count() == 4000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_window_operators_on_one_key(fills):
    own = lambda f: f(rows=30)
    for f in (
        lambda **k: W.rolling_mean(fills, ["symbol"], ORDER, "price", 7, "m", **k),
        lambda **k: W.rolling_flow_imbalance(fills, ["symbol"], ORDER, 20, **k),
        lambda **k: W.every_nth(fills, ["symbol"], ORDER, 10, **k),
        lambda **k: W.cumulative_counters(fills, ["symbol"], ORDER, **k),
        lambda **k: W.drawdown(fills.filter("price > 0"), ["symbol"], ORDER, "price", 2.0, **k),
        lambda **k: W.running_product(fills.filter("price > 0"), ["symbol"], ORDER, F.col("price"), "p", 2.0, **k),
    ):
        same(own(f), f())


# -- the book over time ------------------------------------------------------------------------


def book_at(events, fills, symbol, t, before):
    """Levels of one symbol from scratch, by the rules of resting_orders."""
    ok = (lambda x: x < t) if before else (lambda x: x <= t)
    orders = {}
    for time, event, order, action, side, price, quantity, sym in sorted(events, key=lambda e: e[:2]):
        if ok(time):
            o = orders.setdefault(order, {"price": None, "quantity": None, "side": None, "symbol": None, "dead": False})
            o["dead"] |= action == "CANCEL"
            if action in ("NEW", "AMEND"):
                o["price"], o["quantity"] = price if price is not None else o["price"], quantity if quantity is not None else o["quantity"]
            if action == "NEW" and o["side"] is None:
                o["side"], o["symbol"] = side, sym
    done = {}
    for order, quantity, time in fills:
        if ok(time):
            done[order] = done.get(order, 0) + quantity
    levels = {}
    for name, o in orders.items():
        left = (o["quantity"] or 0) - done.get(name, 0)
        if not o["dead"] and o["side"] and o["symbol"] == symbol and left > 0:
            q, n = levels.get((o["side"], o["price"]), (0, 0))
            levels[o["side"], o["price"]] = q + left, n + 1
    return levels


@pytest.mark.parametrize("before", [False, True])
def test_book_series_is_the_book_of_each_time(spark, before):
    rng = random.Random(3)
    events = []
    for i in range(300):
        action = rng.choice(["NEW", "NEW", "NEW", "AMEND", "CANCEL"])
        order = f"o{i}" if action == "NEW" else f"o{max(0, i - rng.randrange(1, 30))}"
        events.append((i * 10 // 2 * 2, i, order, action, rng.choice(["BUY", "SELL"]), rng.choice([None, 1.0, 2.0, 3.0, 4.5, 7.0]) if action == "AMEND" else float(rng.randrange(1, 12)), rng.randrange(1, 30), rng.choice(["a", "a", "b"])))
    fills = [(f"o{rng.randrange(300)}", rng.randrange(1, 9), rng.randrange(3000)) for _ in range(150)]
    points = [(s, t) for s in ("a", "b", "none") for t in rng.sample(range(3000), 37)]
    ev = spark.createDataFrame(events, "time_ns long, event_id long, order_id string, action string, side string, price double, quantity long, symbol string")
    fl = spark.createDataFrame(fills, "order_id string, quantity long, time_ns long")
    pt = spark.createDataFrame(points + points[:5], "symbol string, time_ns long")
    got = O.book_series(ev, pt, fl, top=3, before=before, rows=60).collect()
    assert len(got) == len(points)
    for r in got:
        want = book_at(events, fills, r["symbol"], r["time_ns"], before)
        for name, side, sign in (("bids", "BUY", -1), ("asks", "SELL", 1)):
            best = sorted((sign * p, p, q, n) for (s, p), (q, n) in want.items() if s == side)[:3]
            assert [tuple(x) for x in r[name]] == [b[1:] for b in best]
        assert r["nth"] == sum(s == r["symbol"] and t <= r["time_ns"] for s, t in points)


def test_spans_cover_each_point_once(spark):
    cases = [(a, b) for a in range(0, 40, 3) for b in range(a + 1, 70, 5)] + [(0, 1 << 30), (5, (1 << 33) + 3)]
    df = spark.createDataFrame(cases, "since long, till long").select("since", "till", O._spans(F.col("since"), F.col("till")).alias("s"))
    for r in df.collect():
        spans = sorted((s["number"] << s["level"], (s["number"] + 1) << s["level"]) for s in r["s"])
        assert spans[0][0] == r["since"] and spans[-1][1] == r["till"] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) <= 2 * max(1, (r["till"] - r["since"]).bit_length())


def test_empty_books(spark):
    ev = spark.createDataFrame([], "time_ns long, event_id long, order_id string, action string, side string, price double, quantity long, symbol string")
    pt = spark.createDataFrame([("a", 5)], "symbol string, time_ns long")
    assert [(r["bid"], r["mid"], r["nth"]) for r in O.top_of_series(O.book_series(ev, pt)).collect()] == [(None, None, 1)]
    assert O.book_series(ev, pt.limit(0)).count() == 0
