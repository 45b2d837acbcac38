"""Round trips of the readers, writers and streams."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from matchgrid.operators import orders as L
from matchgrid.plans import source_queries as Q
from matchgrid.sources import readers as S
from matchgrid.streaming import streams as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, b", 0.5), (2, None, None)], "id long, name string, x double")
    S.write_csv(df, str(tmp_path / "t"))
    assert rows(S.read_table(spark, str(tmp_path / "t"), "id long, name string, x double", "career")) == [(1, "a, b", 0.5, "career"), (2, None, None, "career")]


def test_many_files_with_placeholders(spark, tmp_path):
    (tmp_path / "a_stats.csv").write_text("id,x\n1,2\n")
    (tmp_path / "b_stats.csv").write_text("\n")
    (tmp_path / "c_other.csv").write_text("id,x\n9,9\n")
    assert rows(S.read_many(spark, str(tmp_path), "_stats.csv", "id long, x long")) == [(1, 2)]


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "x": "a"}, {"id": 2}]))
    assert rows(S.read_json_array(spark, str(tmp_path / "a.json"), "id long, x string")) == [(1, "a"), (2, None)]
    S.write_jsonl(spark.createDataFrame([(1, "a")], "id long, x string"), str(tmp_path / "l"))
    assert rows(S.read_jsonl(spark, str(tmp_path / "l"), "id long, x string")) == [(1, "a")]


def test_regimes(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"fixture_id": 1}]')
    paths = {"pregame": str(tmp_path / "p.json"), "halftime": str(tmp_path / "none.json")}
    assert rows(S.load_regimes(spark, paths, ["pregame", "halftime"], "fixture_id long")) == [(1, "pregame")]
    with pytest.raises(FileNotFoundError):
        S.load_regimes(spark, paths, ["halftime"], "fixture_id long", strict=True)
    with pytest.raises(ValueError, match="unknown"):
        S.load_regimes(spark, paths, ["later"], "fixture_id long")


def test_chart_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text(" Date , Value\n2024-01-01,1.5\nsoon,2\n2024-01-02,x\n")
    assert [r["value"] for r in S.read_chart_csv(spark, str(tmp_path / "c.csv")).collect()] == [1.5]
    (tmp_path / "d.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="time"):
        S.read_chart_csv(spark, str(tmp_path / "d.csv"))


def test_partitioned(spark, tmp_path):
    df = spark.createDataFrame([("Costa Rica", 1), ("Cote d'Ivoire", 2)], "team string, x int")
    S.write_partitioned(df, str(tmp_path / "p"), "team")
    assert sorted(p.name for p in (tmp_path / "p").glob("slug=*")) == ["slug=costa_rica", "slug=cote_divoire"]
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_ingest_reads_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n in (1, 2):
        (source / f"{n}.json").write_text(json.dumps({"id": n}))
        R.incremental_ingest(spark, str(source), "id long", str(tmp_path / "out"), str(tmp_path / "ck"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(1,), (2,)]


def test_stream_equals_batch(spark, tmp_path):
    fills = spark.range(200).select(
        F.col("id").alias("event_id"), (F.col("id") % 3).alias("symbol"), F.when(F.col("id") % 4 == 0, "SELL").otherwise("BUY").alias("taker_side"), (F.col("id") % 7 + 1.0).alias("price"), (F.col("id") % 5 + 1).alias("quantity"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("id") * 60).alias("ts"), F.col("id").alias("time_ns"),
    )
    fills.write.parquet(str(tmp_path / "fills"))
    seen = []
    stream = spark.readStream.schema(fills.schema).parquet(str(tmp_path / "fills"))
    R.on_batch(stream, lambda df, _: seen.append(df.count()), str(tmp_path / "ck")).awaitTermination()
    assert sum(seen) == 200
    got, late = R.windows_and_late(spark.readStream.schema(fills.schema).parquet(str(tmp_path / "fills")), str(tmp_path / "out"))
    names = ("start", "symbol", "trades", "volume", "buy_volume", F.round("vwap", 9))
    batch = L.trade_metrics(fills.withColumn("start", F.date_trunc("hour", "ts")), ["start", "symbol"])
    closed = batch.filter(F.col("start") + F.expr("interval 1 hour") <= F.lit(fills.agg(F.max("ts")).first()[0]) - F.expr("interval 10 minutes"))
    assert rows(got.select(*names)) == rows(closed.select(*names)) and closed.count() > 0 and late.count() == 0


def test_late_fills_stand_apart_and_restarts_go_on(spark, tmp_path):
    """Files out of order, with a restart after each: what comes after its window closed is in no window."""
    schema = "event_id long, symbol long, taker_side string, price double, quantity long, ts timestamp, time_ns long"
    t0 = dt.datetime(2024, 1, 1)
    at = lambda i, minutes: (i, i % 2, "BUY", 2.0, 10, None if minutes is None else t0 + dt.timedelta(minutes=minutes), i)
    arrivals = [[at(1, 5), at(2, 50)], [at(3, 65), at(4, 55)], [at(5, 200), at(6, 59), at(7, None)], [at(8, 30), at(9, 61), at(10, 190)], [at(11, 400)]]
    out, results = str(tmp_path / "out"), []
    for i, arrival in enumerate(arrivals):
        spark.createDataFrame(arrival, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        if i == 3:  # a run that fails before it has committed its batch
            query = R.split_late(stream, out)
            query.awaitTermination()
            last = sorted((tmp_path / "out" / "split" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
            last.unlink()
            last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
        windows, late = R.windows_and_late(stream, out)
        results.append(([tuple(r) for r in windows.select("start", "symbol", "trades").collect()], sorted(r[0] for r in late.select("event_id").collect())))
    assert [late for _, late in results] == [[], [], [7], [7, 8, 9], [7, 8, 9]]
    hour = lambda h: t0 + dt.timedelta(hours=h)
    assert sorted(results[2][0]) == [(hour(0), 0, 3), (hour(0), 1, 1), (hour(1), 1, 1)]
    assert sorted(results[4][0]) == sorted([(hour(0), 0, 3), (hour(0), 1, 1), (hour(1), 1, 1), (hour(3), 0, 1), (hour(3), 1, 1)])


def test_running_totals_go_on_after_a_restart(spark, tmp_path):
    schema = "event_id long, symbol long, quantity long, time_ns long"
    data = [(i, None if i % 11 == 0 else i % 3, i % 7 or None, i) for i in range(60)]
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, Q.ROCKSDB)
    try:
        for i in range(3):
            spark.createDataFrame(data[20 * i : 20 * i + 20], schema).write.mode("append").parquet(str(tmp_path / "in"))
            R.append_to_table(R.stream_running_totals(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), "update")
    finally:
        spark.conf.set(store, before)
    got = spark.read.schema(R.TOTALS).parquet(str(tmp_path / "out" / "result"))
    assert got.count() == 60  # each batch wrote its own fills only
    seen = {}
    for r in sorted(got.collect(), key=lambda r: r["event_id"]):
        _, symbol, quantity, _ = data[r["event_id"]]
        n, volume = seen.get(symbol, (0, 0))
        seen[symbol] = n + 1, volume + (quantity or 0)
        assert (r["symbol"], r["total_trades"], r["total_volume"]) == (symbol, *seen[symbol])


def test_whole_tables_go_through_bounded_groups(spark, monkeypatch):
    fills = spark.range(120_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("symbol"), (F.col("id") % 7 + 1).cast("double").alias("price"))
    pages = Q.chart_pages(fills).select(F.size(F.from_json("j", "values array<struct<x:bigint,y:double>>")["values"]).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert pages[0] <= 500 and pages[1] == 120_000
    keys = []
    applied = R.grouped_apply
    monkeypatch.setattr(R, "grouped_apply", lambda df, by, fn, schema: keys.append(df.groupBy(*by).count().agg(F.max("count")).first()[0]) or applied(df, by, fn, schema))
    got = Q.above_low(fills)
    assert keys[0] <= 50_000 // 3 + 1
    assert got.agg(F.count("*"), F.sum("above_low")).first() == fills.agg(F.count("*"), F.sum(F.col("price") - 1)).first()
