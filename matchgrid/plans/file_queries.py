"""Queries S1-S5, S12, S16-S19, R3 and R4: the given tables written out in a format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrid.plans.registry import query
from matchgrid.sources import feeds, readers
from matchgrid.streaming import streams

c, lit = F.col, F.lit

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
ORDER_NAMES = [x.split()[0] for x in ORDERS.split(", ")]
ORDER_SQL = f"SELECT {', '.join(ORDER_NAMES)} FROM orders"


def folder(v, name):
    return streams.shared_folder(v.spark, name)


@query("s01_read_table", f"SELECT {', '.join(ORDER_NAMES)}, 'feed' AS source FROM orders")
def s01(v):
    path = folder(v, "table")
    v.orders.select(*ORDER_NAMES).write.csv(path, header=True)
    return readers.read_table(v.spark, path, ORDERS, "feed")


@query("s02_read_many", ORDER_SQL)
def s02(v):
    """One folder of files, of which those of another suffix don't count."""
    path = folder(v, "many")
    v.orders.select(*ORDER_NAMES).write.csv(path, header=True)
    v.orders.select(*ORDER_NAMES).write.mode("append").json(path)
    return readers.read_many(v.spark, path, ".csv", ORDERS)


@query("s03_read_json_array", ORDER_SQL)
def s03(v):
    path = folder(v, "array")
    readers.write_json_records(v.orders.select(*ORDER_NAMES), path)
    return readers.read_json_array(v.spark, path, ORDERS)


@query("s04_read_jsonl", ORDER_SQL)
def s04(v):
    path = folder(v, "lines")
    readers.write_jsonl(v.orders.select(*ORDER_NAMES), path)
    return readers.read_jsonl(v.spark, path, ORDERS)


@query("s05_load_regimes", "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 'pregame' ELSE 'halftime' END AS regime FROM orders")
def s05(v):
    """A file for each of two regimes; that of the third is missing."""
    path = folder(v, "regimes")
    rows = v.orders.select("o_orderkey", "o_totalprice")
    readers.write_json_records(rows.filter("o_orderkey % 2 = 0"), f"{path}/pregame")
    readers.write_json_records(rows.filter("o_orderkey % 2 <> 0"), f"{path}/halftime")
    paths = {r: f"{path}/{r}" for r in ("pregame", "halftime", "events")}
    return readers.load_regimes(v.spark, paths, list(paths), "o_orderkey bigint, o_totalprice double")


@query("s12_flatten_teams", "SELECT s_suppkey AS team_id, s_name AS team_name, n_name AS country, NULL::VARCHAR AS venue_name, s_nationkey::BIGINT AS venue_capacity FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def s12_teams(v):
    team = F.struct(c("s_suppkey").alias("id"), c("s_name").alias("name"), c("n_name").alias("country"))
    entry = F.struct(team.alias("team"), F.struct(c("s_nationkey").cast("long").alias("capacity")).alias("venue"))
    rows = v.supplier.join(v.nation, c("s_nationkey") == c("n_nationkey")).select(F.to_json(F.struct(F.array(entry).alias("response"))).alias("j"))
    return feeds.flatten_teams(feeds.parsed(rows, "j", feeds.TEAMS))


@query("s16_read_chart_csv", "SELECT date_trunc('second', ts) AS time, value FROM events WHERE value IS NOT NULL")
def s16(v):
    """Headers padded and in another case; values that don't parse are dropped."""
    path = folder(v, "chart")
    rows = v.events.select(F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias(" Timestamp "), F.coalesce(c("value").cast("string"), lit("n/a")).alias(" VALUE"))
    rows.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_chart_csv(v.spark, path)


@query("s17_write_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def s17(v):
    path = folder(v, "csv")
    readers.write_csv(v.customer.select("c_custkey", "c_name", "c_acctbal"), path)
    return v.spark.read.schema("c_custkey bigint, c_name string, c_acctbal double").csv(path, header=True)


@query("s18_write_json_records", "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS c_name, c_acctbal FROM customer")
def s18(v):
    path = folder(v, "records")
    readers.write_json_records(v.customer.select("c_custkey", F.when(c("c_custkey") % 3 > 0, c("c_name")).alias("c_name"), "c_acctbal"), path)
    return readers.read_json_array(v.spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("s19_write_partitioned", "SELECT c_custkey, c_mktsegment FROM customer")
def s19(v):
    path = folder(v, "parts")
    readers.write_partitioned(v.customer.select("c_custkey", "c_mktsegment"), path, "c_mktsegment")
    return v.spark.read.parquet(path).select("c_custkey", "c_mktsegment")


@query("r03_on_batch", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def r03(v):
    """Every batch is counted by the hook; the counts of all batches are added up."""
    path = folder(v, "batches")
    events = v.spark.readStream.schema(v.events.schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)

    def count(batch, i):
        batch.groupBy("event_type").count().write.mode("overwrite").parquet(f"{path}/counts/batch={i}")

    streams.on_batch(events.select("event_type"), count, f"{path}/log").awaitTermination()
    counts = v.spark.read.schema("event_type string, count bigint, batch int").parquet(f"{path}/counts")
    return counts.groupBy("event_type").agg(F.sum("count").alias("n"))


@query("r04_incremental_ingest", "SELECT c_custkey, c_name FROM customer")
def r04(v):
    """Two arrivals of files and a run after each: no file is taken twice."""
    path = folder(v, "ingest")
    rows = v.customer.select("c_custkey", "c_name")
    for part in (0, 1):
        rows.filter(F.pmod("c_custkey", lit(2)) == part).write.mode("append").json(f"{path}/in")
        streams.incremental_ingest(v.spark, f"{path}/in", "c_custkey bigint, c_name string", f"{path}/table", f"{path}/log")
    return v.spark.read.schema("c_custkey bigint, c_name string").parquet(f"{path}/table")
