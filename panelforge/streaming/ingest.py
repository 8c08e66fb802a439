"""Incremental ingestion with Structured Streaming: idempotent inserts, watermarked windows, keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, files_a_batch: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as they arrive; the checkpoint of the query that reads them is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", pattern).parquet(path)


def timed(events: DataFrame, time: str) -> DataFrame:
    """Event time as an instant: wall-clock times are read in the session's zone."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def once_only(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Rows whose key was not seen within the delay: repeated deliveries change nothing and old keys are forgotten."""
    return timed(events, time).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, time: str, delay: str, size: str, slide: str | None, by: list[str], value: str) -> DataFrame:
    """Counts and sums of event-time windows; rows later than the delay are left out (window_parts counts them)."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    g = timed(events, time).withWatermark(time, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(events: DataFrame, time: str, delay: str, gap: str, by: list[str]) -> DataFrame:
    """Sessions by event time; rows later than the delay are left out (session_parts counts them)."""
    g = timed(events, time).withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def run_parts(df: DataFrame, checkpoint: str, path: str, part: Callable[[DataFrame], DataFrame]) -> None:
    """Every micro-batch summarised by `part` under batch=N, as parts that later merge: no state and no watermark, so no row comes too late. A batch that is replayed overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def window_parts(time: str, size: str, slide: str | None, by: list[str], value: str) -> Callable[[DataFrame], DataFrame]:
    """Counts and sums of a batch's rows by event-time window, for run_parts."""

    def part(batch: DataFrame) -> DataFrame:
        w = F.window(F.col(time).cast("timestamp"), size, slide)
        return batch.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")

    return part


def merged_windows(parts: DataFrame, by: list[str]) -> DataFrame:
    """Windows of all rows from the parts of all batches, whatever their order."""
    return parts.groupBy("window_start", "window_end", *by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def session_parts(time: str, gap: str, by: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Sessions among a batch's rows, for run_parts; a session ends `gap` after its last row."""

    def part(batch: DataFrame) -> DataFrame:
        g = batch.withColumn(time, F.col(time).cast("timestamp")).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
        return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")

    return part


def merged_sessions(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sessions of all rows: those of single batches joined where they touch. Two rows are in one session if a chain of gaps at most `gap` connects them, so the union of the batches' sessions is that of all rows."""
    w = W.partitionBy(*by).orderBy("session_start", "session_end")
    before = F.max("session_end").over(w.rowsBetween(W.unboundedPreceding, -1))
    d = parts.withColumn("__new", F.when(F.col("session_start") <= before, 0).otherwise(1)).withColumn("__k", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(*by, "__k").agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("n").alias("n")).select("session_start", "session_end", *by, "n")


def run_available(df: DataFrame, checkpoint: str, path: str, mode: str = "append") -> None:
    """Process what is there and stop; a rerun with the same checkpoint goes on where this one ended."""
    df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def run_changes(df: DataFrame, checkpoint: str, path: str, mode: str = "update") -> None:
    """Like run_available, with the rows each batch changed (or, in complete mode, all rows) under batch=N: windows that are still open are there too. A batch that is replayed overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_rows(written: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key among the rows of run_changes."""
    order = W.partitionBy(*keys).orderBy(F.col("batch").desc())
    return written.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "batch")


def upsert_batches(df: DataFrame, checkpoint: str, table_path: str, keys: list[str], order: str, buckets: int = 16) -> None:
    """Keyed upserts by micro-batch: the row with the largest `order` wins, whichever came last. Keys lie in hash buckets; a batch writes new versions of the buckets it touches, from the versions before it, so one that is replayed ends in the same rows."""
    from panelforge.sources.store import upsert

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets` numbers
        before = _bucket_paths(spark, table_path, number, touched)
        held = spark.read.schema(rows.schema).option("basePath", table_path).parquet(*before) if before else rows.limit(0)
        upsert(held.select(rows.columns), rows, keys, order, by_sequence=True).write.mode("overwrite").partitionBy("bucket").parquet(f"{table_path}/version={number}")

    df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _bucket_paths(spark: SparkSession, table_path: str, below: int | None = None, buckets: list[int] | None = None) -> list[str]:
    """Folders of the newest version (below a number) of each bucket."""
    at = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    newest: dict[int, int] = {}
    for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/version=*/bucket=*")) or []:
        version, bucket = int(f.getPath().getParent().getName()[8:]), int(f.getPath().getName()[7:])
        if (below is None or version < below) and (buckets is None or bucket in buckets):
            newest[bucket] = max(version, newest.get(bucket, -1))
    return [f"{table_path}/version={v}/bucket={b}" for b, v in sorted(newest.items())]


def current_version(spark: SparkSession, table_path: str) -> DataFrame:
    """The newest version of every bucket of a table that upsert_batches keeps."""
    return spark.read.option("basePath", table_path).parquet(*_bucket_paths(spark, table_path)).drop("version", "bucket")


def drop_old_versions(spark: SparkSession, table_path: str) -> int:
    """Remove bucket versions that newer ones replace; how many went. Not while a batch is running."""
    at = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    keep = {p[len(table_path) :] for p in _bucket_paths(spark, table_path)}
    old = [f.getPath() for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/version=*/bucket=*")) or [] if f"/{f.getPath().getParent().getName()}/{f.getPath().getName()}" not in keep]
    for p in old:
        fs.delete(p, True)
    return len(old)


def retry_windows(days: DataFrame, source: str, day: str, n: str, most: int) -> DataFrame:
    """Days whose fetch came back full (`most` rows or more) may be cut off and are read again: per source the first such day, their
    number, and the cursor, which stays at that day until it is resolved."""
    full = F.when(F.col(n) >= most, F.col(day))
    return days.groupBy(source).agg(F.min(full).alias("unresolved_day"), F.count(full).alias("days"), F.coalesce(F.min(full), F.max(day)).alias("cursor"))


def lifecycle(df: DataFrame, checkpoint: str, path: str, key: str, time: str, state: str, buckets: int = 16) -> None:
    """State machine per key over a stream: how often it changed state, its last state and time, for the keys that each batch touched, under changes/batch=N.

    Rows are kept by hash bucket of the key and a touched key is folded anew over all its rows in the order of time and state, so
    rows that arrive late or out of order count as if they had come in time. A batch that is replayed overwrites what it wrote.
    """

    kind = df.schema[key].dataType.simpleString()

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("at"), F.col(state).alias("state")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={number}")
        now = spark.read.parquet(f"{path}/rows/batch={number}")
        touched = [r["bucket"] for r in now.select("bucket").distinct().collect()]  # at most `buckets` numbers
        held = spark.read.schema(f"key {kind}, at timestamp, state string, bucket int, batch int").option("basePath", f"{path}/rows").parquet(f"{path}/rows").filter((F.col("batch") <= number) & F.col("bucket").isin(touched))
        folded(held.join(now.select("key").distinct(), "key", "left_semi")).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def folded(rows: DataFrame) -> DataFrame:
    """(key, changes, state, at) of (key, at, state) rows: changes from row to row in the order of time and state, the first row included."""
    before = F.lag("state").over(W.partitionBy("key").orderBy("at", "state"))
    d = rows.withColumn("__c", (before.isNull() | (before != F.col("state"))).cast("long"))
    return d.groupBy("key").agg(F.sum("__c").alias("changes"), F.max_by("state", F.struct("at", "state")).alias("state"), F.max("at").alias("at"))
