"""Streams over several files in any order have the rows of their SQL; pending orders equal a loop over micro-batches."""

import datetime as dt
import random

import duckdb
import pytest
from test_catalog import plain

from panelforge.plans import catalog
from panelforge.streaming import ingest, orders

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The events of the smallest tables in ten files whose rows are in no order."""
    path = tmp_path_factory.mktemp("shuffled")
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").toPandas().sample(frac=1, random_state=3)
    (path / "events.parquet").mkdir()
    for k in range(10):
        rows.iloc[k::10].to_parquet(path / f"events.parquet/part-{k}.parquet", index=False, coerce_timestamps="us")
    return str(path)


@pytest.mark.parametrize("name", ["st1_idempotent_ingest", "stream_windowed_counts", "stream_sessions", "st6_lifecycle_state", "st6_pending_orders", "st7_upsert_sink"])
def test_stream_equals_its_sql_over_shuffled_files(spark, shuffled, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{shuffled}/events.parquet/*.parquet'")
    got, want = catalog.QUERIES[name](spark, shuffled).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert plain(got) == plain(want)


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    kind = "k long, seq long, v string"
    batches = [[(1, 5, "a"), (2, 1, "b")], [(1, 4, "late"), (3, 1, "c")], [(2, 2, "d")], [(1, 5, "z")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = ingest.stream(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema)
        ingest.upsert_batches(source, str(tmp_path / "cp"), str(tmp_path / "t"), ["k"], "seq", buckets=4)
    table = str(tmp_path / "t")
    want = [(1, 5, "z"), (2, 2, "d"), (3, 1, "c")]
    assert sorted(map(tuple, ingest.current_version(spark, table).collect())) == want
    assert ingest.drop_old_versions(spark, table) > 0
    assert sorted(map(tuple, ingest.current_version(spark, table).collect())) == want
    assert len(ingest._bucket_paths(spark, table)) <= 3


def loop(batches, ttl, delay):
    """Orders resolved micro-batch by micro-batch; a batch's timers see the watermark of the rows before it, its late rows that of the batch before."""
    open_, out, top, late = {}, [], None, None
    for rows in [*batches, []]:
        mark = None if top is None else top - delay
        for t, action, account, order in sorted((r for r in rows if late is None or r[0] > late), key=lambda r: (r[0], orders.RANK[r[1]], r[3] or 0)):
            if action == "place":
                open_.setdefault((account, order), t)
                continue
            for key in sorted(k for k in open_ if k[0] == account and order in (None, k[1])):
                placed = open_.pop(key)
                out.append((*key, action if t <= placed + ttl else "expired", placed, min(t, placed + ttl)))
        for key, placed in sorted(open_.items()):
            if mark is not None and placed + ttl <= mark:
                out.append((*key, "expired", placed, placed + ttl))
                del open_[key]
        late = mark
        top = max([r[0] for r in rows] + ([top] if top else []), default=top)
    return sorted(out)


def test_pending_orders_equal_a_loop_with_late_rows_and_expiry(spark, tmp_path):
    random.seed(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=i, seconds=random.random() * 50), random.choice(["place", "place", "fill", "cancel"]), random.randrange(4), i) for i in range(300)]
    rows = [(t, a, k, i if a == "place" else None if random.random() < 0.3 else random.randrange(max(1, i))) for t, a, k, i in rows]
    rows.sort(key=lambda r: r[0] + dt.timedelta(minutes=random.choice([0, 0, 0, 10, 90])))  # some come late
    batches = [rows[k : k + 60] for k in range(0, 300, 60)]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for b in batches:
            spark.createDataFrame(b, "time timestamp, action string, account long, order_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = ingest.stream(spark, str(tmp_path / "in"), "time timestamp, action string, account long, order_id long")
            out = orders.resolved_orders(source, "account", "order_id", "action", "time", 30 * 60_000, "20 minutes")
            ingest.run_available(out, str(tmp_path / "cp"), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()
    want = loop_runs(batches, dt.timedelta(minutes=30), dt.timedelta(minutes=20))
    assert sorted((r["account"], r["order_id"], r["status"], r["placed"], r["at"]) for r in got) == want
    assert {r[2] for r in want} == {"fill", "cancel", "expired"}


def loop_runs(batches, ttl, delay):
    """Each run ends with a batch without rows, which moves the watermarks on."""
    return loop([b for rows in batches for b in (rows, [])], ttl, delay)
