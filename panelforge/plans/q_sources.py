"""Scans and sinks as queries: what is written to the shared folder is read again and compared with its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.scalar import code_key
from panelforge.operators import pit
from panelforge.plans.base import query
from panelforge.sources import store


def folder(t, name):
    return store.shared_folder(t.spark, name)


@query("s1_csv_scan", "SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code, strftime(o_orderdate, '%Y%m%d') AS trade_date, o_totalprice AS price, o_orderkey FROM orders")
def _(t):
    path = folder(t, "csv")
    o = t.orders.select(code_key(F.col("o_custkey")).alias("code"), F.date_format("o_orderdate", "yyyyMMdd").alias("trade_date"), F.col("o_totalprice").alias("price"), "o_orderkey")
    o.write.option("header", True).csv(path)
    return store.csv_scan(t.spark, path, "code string, trade_date string, price double, o_orderkey long")


@query("s2_history_scan", "SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, strftime(l_shipdate, '%Y%m%d') AS trade_date, count(*) AS n, sum(CASE WHEN l_returnflag <> 'A' THEN l_quantity END) AS volume, sum(CAST(l_linestatus = 'O' AS INTEGER)) AS open_flags FROM lineitem GROUP BY 1, 2")
def _(t):
    path = folder(t, "history")
    l = t.lineitem.select(code_key(F.col("l_suppkey")).alias("代码"), F.date_format("l_shipdate", "yyyyMMdd").alias("日期"), F.when(F.col("l_returnflag") == "A", "--").otherwise(F.col("l_quantity").cast("string")).alias("成交量"), F.when(F.col("l_linestatus") == "O", "是").otherwise("0").alias("st"))
    l.write.option("header", True).csv(path)
    d = store.history_scan(t.spark, path, ["volume"], ("st",))
    return d.groupBy("code", "trade_date").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), F.sum(F.col("st").cast("long")).alias("open_flags"))


@query("s3_close_panel", "SELECT strftime(l_shipdate, '%Y%m%d') AS trade_date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, arg_max(l_extendedprice, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice}) AS close FROM lineitem GROUP BY 1, 2")
def _(t):
    path = folder(t, "daily")
    l = t.lineitem.select(F.date_format("l_shipdate", "yyyyMMdd").alias("trade_date"), code_key(F.col("l_suppkey")).alias("code"), F.col("l_extendedprice").alias("close"), "l_orderkey", "l_linenumber", "l_partkey")
    l.repartition("trade_date").write.option("header", True).csv(path)
    scan = store.csv_scan(t.spark, path, "trade_date string, code string, close double, l_orderkey long, l_linenumber int, l_partkey long")
    return store.close_panel(scan, "trade_date", "code", "close", ["l_orderkey", "l_linenumber", "l_partkey", "close"])


@query("s6_snapshot", "SELECT p_partkey, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS price, '20240131' AS as_of FROM part", "price", 3)
def _(t):
    path = folder(t, "snapshots")
    for _again in range(2):  # a second run replaces the snapshot
        store.write_snapshot(t.part.select("p_partkey", F.col("p_retailprice").alias("price")), path, "20240131")
    d = t.spark.read.parquet(path)
    return d.select("p_partkey", F.col("price").cast("double").alias("price"), F.col("as_of").cast("string").alias("as_of"))


@query("s5_row_group_statistics", "SELECT min(CAST(l_shipdate AS DATE)) AS first, max(CAST(l_shipdate AS DATE)) AS last, count(*) AS rows FROM lineitem")
def _(t):
    path = store.write_snapshot(t.lineitem.select(F.to_date("l_shipdate").alias("d"), "l_suppkey"), folder(t, "statistics"), "20240101")
    return store.statistics_bounds(t.spark, path, "d")[0]


@query("s7_incremental_write", "SELECT event_type, user_id % 4 AS bucket, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2")
def _(t):
    path = folder(t, "events")
    e = t.events.select("event_type", "event_id", (F.col("user_id") % 4).alias("bucket"))
    for k in range(2):
        store.append_partitions(e.filter(F.col("bucket") % 2 == k), path, ["bucket"])
    d = t.spark.read.schema("event_type string, event_id long, bucket long").parquet(path)
    return d.groupBy("event_type", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("s10_append_and_replace_csv", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def _(t):
    path = folder(t, "ledger")
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    store.append_csv(o.filter("o_orderstatus = 'F'"), path)
    store.append_csv(o.filter("o_orderstatus <> 'F'"), path)
    held = store.csv_scan(t.spark, path, o.schema)
    store.replace_csv(held.filter("o_orderstatus <> 'P'"), path)
    return store.csv_scan(t.spark, path, o.schema).select("o_orderkey", "o_totalprice")


@query("s13_staged_by_code", "SELECT l_suppkey, count(*) AS n, count(DISTINCT strftime(l_shipdate, '%Y%m%d')) AS days, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def _(t):
    path = folder(t, "staged")
    l = t.lineitem.select("l_suppkey", F.date_format("l_shipdate", "yyyy").alias("year"), F.date_format("l_shipdate", "yyyyMMdd").alias("d"), "l_quantity")
    store.append_partitions(l, path, ["year"])
    d = t.spark.read.schema("l_suppkey long, d string, l_quantity double, year string").parquet(path)
    return d.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("d").alias("days"), F.sum("l_quantity").alias("quantity"))


@query("s14_resumable_backfill", "SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS rows, CASE WHEN strftime(o_orderdate, '%Y') <= '1994' THEN 'kept' ELSE 'written' END AS status FROM orders GROUP BY 1")
def _(t):
    path = folder(t, "backfill")
    o = t.orders.select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy").alias("year"))
    store.backfill(o.filter("year <= '1994'"), path, "year")
    return store.backfill(o, path, "year").select("year", "rows", "status")


@query("s15_compacted", "SELECT l_suppkey, l_shipdate, l_quantity FROM lineitem WHERE l_suppkey <= 3")
def _(t):
    path = folder(t, "compact")
    store.write_clustered(t.lineitem.select("l_suppkey", "l_shipdate", "l_quantity"), path, ["l_suppkey", "l_shipdate"], 8)
    return store.subset(t.spark, path, ["l_suppkey", "l_shipdate", "l_quantity"], "l_suppkey <= 3")


@query("s18_put_if_absent", "SELECT sha256(text) AS key, max(strlen(text)) AS size, NOT bool_or(doc_id % 2 = 0) AS added FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(t):
    path = folder(t, "blobs")
    store.put_if_absent(t.documents.filter("doc_id % 2 = 0"), path, "text")
    return store.put_if_absent(t.documents, path, "text")


@query("s19_config_overlay", "SELECT p_partkey FROM part WHERE p_size >= 20 AND p_retailprice < 1500")
def _(t):
    c = store.merged_config({"filters": {"size": 5, "price": 1500.0}, "costs": {"rate": 0.0003}}, {"filters": {"size": 20}}, locked=("costs.rate",))
    return t.part.filter((F.col("p_size") >= c["filters"]["size"]) & (F.col("p_retailprice") < c["filters"]["price"])).select("p_partkey")


@query("j21_nearest_previous_file", """WITH f AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders), r AS (SELECT date_trunc('month', o_orderdate) AS m, o_custkey, max(o_totalprice) AS cap FROM orders GROUP BY 1, 2), d AS (SELECT DISTINCT o_custkey, o_orderdate AS d FROM orders),
 p AS (SELECT d.o_custkey, d.d, f.m FROM d ASOF LEFT JOIN f ON d.d > f.m) SELECT p.o_custkey, p.d, p.m AS asof, r.cap FROM p LEFT JOIN r ON r.m = p.m AND r.o_custkey = p.o_custkey""")
def _(t):
    o = t.orders.withColumn("m", F.date_trunc("month", "o_orderdate"))
    files = o.groupBy("m", "o_custkey").agg(F.max("o_totalprice").alias("cap"))
    wanted = t.orders.select("o_custkey", F.col("o_orderdate").alias("d")).distinct()
    return pit.nearest_file(wanted, files, "d", "m", ["o_custkey"]).select("o_custkey", "d", "asof", "cap")


@query("st3_two_clocks", """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE late) AS late FROM (SELECT event_type, ts, ts + INTERVAL 1 DAY * (event_id % 5) AS seen, event_id % 5 > 1 AS late FROM events) WHERE seen <= TIMESTAMP '2024-01-20' GROUP BY 1""")
def _(t):
    from panelforge.operators import documents as docs

    e = t.events.select("event_id", "event_type", F.col("ts").alias("published"), (F.col("ts") + F.expr("make_dt_interval(int(event_id % 5))")).alias("first_seen"))
    v = docs.visible(e, F.lit("2024-01-20").cast("timestamp_ntz"), "published", "first_seen", "24 hours")
    return v.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("late").cast("long")).alias("late"))


@query("st4_retry_windows", """WITH d AS (SELECT event_type AS source, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, n >= 8 AS saturated FROM d)
 SELECT source, min(d) FILTER (WHERE saturated) AS unresolved_day, count(*) FILTER (WHERE saturated) AS days, coalesce(min(d) FILTER (WHERE saturated), max(d)) AS cursor FROM s GROUP BY 1""")
def _(t):
    from panelforge.streaming import ingest

    days = t.events.groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return ingest.retry_windows(days, "source", "d", "n", 8)


@query("st7_upsert_sink", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def _(t):
    from panelforge.plans.q_accounts import _source
    from panelforge.streaming import ingest

    source, path = _source(t)
    ingest.upsert_batches(source.select("user_id", "event_type", "event_id", "value"), f"{path}/checkpoint", f"{path}/table", ["user_id", "event_type"], "event_id")
    return ingest.current_version(t.spark, f"{path}/table")


@query("st6_lifecycle_state", """WITH e AS (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events) SELECT user_id AS key, count(*) FILTER (WHERE before IS NULL OR before <> event_type) AS changes, arg_max(event_type, {'a': ts, 'b': event_type}) AS state FROM e GROUP BY 1""")
def _(t):
    from panelforge.plans.q_accounts import _source
    from panelforge.streaming import ingest

    source, path = _source(t)
    ingest.lifecycle(source, f"{path}/checkpoint", path, "user_id", "ts", "event_type")
    rows = t.spark.read.option("basePath", f"{path}/changes").parquet(f"{path}/changes")
    return ingest.latest_rows(rows, ["key"]).select("key", "changes", "state")


@query("st6_pending_orders", """WITH p AS (SELECT user_id, event_id, ts, ts + INTERVAL 12 HOUR AS until FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, event_type FROM events WHERE event_type IN ('signup', 'error')), w AS (SELECT max(ts) - INTERVAL 1 DAY AS w FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
 j AS (SELECT p.*, r.ts AS rt, r.event_type AS how FROM p ASOF LEFT JOIN r ON p.user_id = r.user_id AND p.ts < r.ts)
 SELECT user_id AS account, event_id AS order_id, CASE WHEN rt <= until THEN CASE how WHEN 'signup' THEN 'fill' ELSE 'cancel' END ELSE 'expired' END AS status, ts AS placed, CASE WHEN rt <= until THEN rt ELSE until END AS "at" FROM j, w WHERE rt IS NOT NULL OR date_trunc('millisecond', until) <= date_trunc('millisecond', w)""")
def _(t):
    from panelforge.plans.q_accounts import _plain_times, _source
    from panelforge.streaming import ingest, orders

    conf, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = t.spark.conf.get(conf, None)
    t.spark.conf.set(conf, provider)
    try:
        source, path = _source(t, 10_000)  # what is there is one batch, whatever its files: nothing is late
        action = F.when(F.col("event_type") == "purchase", "place").when(F.col("event_type") == "signup", "fill").when(F.col("event_type") == "error", "cancel")
        acts = source.select("user_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("order_id"), action.alias("action"), "ts")
        out = orders.resolved_orders(acts, "user_id", "order_id", "action", "ts", 12 * 3600 * 1000, "1 day")
        ingest.run_available(out, f"{path}/checkpoint", f"{path}/out")
    finally:
        t.spark.conf.unset(conf) if before is None else t.spark.conf.set(conf, before)
    return _plain_times(t.spark.read.schema(out.schema).parquet(f"{path}/out"), "placed", "at")
