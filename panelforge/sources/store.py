"""Scans and sinks: typed CSV, Parquet snapshots, upserts, retention, configs."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from panelforge.functions.scalar import missing_as_null, to_number

#: Header aliases of provider history files.
ALIASES = {"日期": "trade_date", "代码": "code", "名称": "name", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume", "成交额": "amount", "换手率": "turnover_rate"}


def csv_scan(spark: SparkSession, path: str | list[str], schema: StructType | str, with_file_date: bool = False) -> DataFrame:
    """CSV with pinned types (codes and dates are text, never inferred); optionally the date in the file name."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumn("file_date", F.regexp_extract(F.col("_metadata.file_name"), "(\\d{8})", 1)) if with_file_date else df


def history_scan(spark: SparkSession, path: str | list[str], numbers: list[str], flags: tuple[str, ...] = ()) -> DataFrame:
    """History CSV of a code: aliased headers, numbers coerced, booleans from a strict vocabulary (another token raises)."""
    df = spark.read.option("header", True).csv(path)
    df = df.withColumnsRenamed({k: v for k, v in ALIASES.items() if k in df.columns})
    df = df.withColumns({c: to_number(c) for c in numbers if c in df.columns})
    return df.withColumns({c: strict_flag(c) for c in flags if c in df.columns})


def strict_flag(c: str) -> Column:
    t = F.lower(F.trim(F.col(c)))
    return F.when(t.isNull() | (t == ""), None).when(t.isin("1", "true", "yes", "是"), True).when(t.isin("0", "false", "no", "否"), False).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), t)).cast("boolean"))


def clean_scan(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column."""
    return df.withColumns({f.name: missing_as_null(f.name) for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))})


def subset(spark: SparkSession, path: str, columns: list[str], where: str | None = None) -> DataFrame:
    """Parquet with projection and predicate, both of which reach the scan."""
    df = spark.read.parquet(path)
    return (df.where(where) if where else df).select(*columns)


def bounds(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count(F.lit(1)).alias("rows"))


def statistics_bounds(spark: SparkSession, path: str, column: str) -> tuple[DataFrame, bool]:
    """((first, last, rows) of a Parquet table, whether row-group statistics answered): the aggregate is pushed into the files' footers where the
    column's type keeps exact statistics there (whole numbers, doubles, dates), so no data page is read; else the column is scanned."""
    wanted = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        found = bounds(spark.read.parquet(path), column)
        pushed = "PushedAggregation: [MIN(" in found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()  # one row
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.createDataFrame(rows, found.schema), pushed


def held(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again, which cuts its lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_snapshot(df: DataFrame, path: str, as_of: str, floats: bool = True) -> str:
    """One immutable directory a snapshot date; doubles become floats. Spark's commit makes it appear as a whole."""
    if floats:
        df = df.withColumns({f.name: F.col(f.name).cast("float") for f in df.schema if isinstance(f.dataType, DoubleType)})
    out = f"{path}/as_of={as_of}"
    df.write.mode("overwrite").parquet(out)
    return out


def write_clustered(df: DataFrame, path: str, keys: list[str], files: int) -> None:
    """Many small inputs compacted into few files ordered by key, so that later predicates skip row groups."""
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], sequence: str | None = None, by_sequence: bool = False) -> DataFrame:
    """Union by key, the last write wins: new over existing, then the larger sequence; with by_sequence the larger sequence first. Ties go by the whole row."""
    from panelforge.operators.pit import whole_row

    both = existing.withColumn("__w", F.lit(0)).unionByName(new.withColumn("__w", F.lit(1)), allowMissingColumns=True)
    order = [F.col("__w").desc()] + ([F.col(sequence).desc()] if sequence else [])
    order = order[::-1] if by_sequence else order
    return both.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order, whole_row(both).desc()))).filter("__n = 1").drop("__n", "__w")


def fan_in(calls: dict[str, DataFrame | Exception], observed_at: str) -> tuple[DataFrame | None, list[dict]]:
    """Concatenate source results with their source and observation time; a health row each, secrets in errors masked."""
    import re

    frames, health = [], []
    for name, result in calls.items():
        if isinstance(result, Exception):
            health.append({"source": name, "status": "error", "detail": re.sub(r"(?i)(token|key|password)=\S+", r"\1=***", str(result))})
        else:
            frames.append(result.withColumns({"source": F.lit(name), "observed_at": F.lit(observed_at)}))
            health.append({"source": name, "status": "ok", "detail": ""})
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None), health


def retained(dates: DataFrame, date: str, recent: int, months: int, protected: list[str] = ()) -> DataFrame:
    """Snapshot dates to keep: the newest `recent`, the last of each of the newest `months` months, and protected ones. A table of dates only."""
    d = dates.select(date).distinct()
    by_date = d.withColumn("__n", F.row_number().over(W.orderBy(F.col(date).desc())))
    last = d.groupBy(F.substring(date, 1, 6).alias("__m")).agg(F.max(date).alias(date)).withColumn("__k", F.row_number().over(W.orderBy(F.col("__m").desc()))).filter(F.col("__k") <= months).select(date, F.lit(True).alias("__monthly"))
    return by_date.join(last, date, "left").filter((F.col("__n") <= recent) | F.col("__monthly") | F.col(date).isin(list(protected))).select(date)


def latest_common(a: DataFrame, b: DataFrame, date: str, as_of: str) -> DataFrame:
    return a.select(date).distinct().join(b.select(date).distinct(), date).filter(F.col(date) <= as_of).agg(F.max(date).alias("latest"))


def merged_config(base: dict, overlay: dict, locked: tuple[str, ...] = (), path: str = "") -> dict:
    """Deep merge of an overlay into a baseline; a locked path that would change raises."""
    out = dict(base)
    for k, v in overlay.items():
        here = f"{path}.{k}" if path else k
        if isinstance(v, dict) and isinstance(base.get(k), dict):
            out[k] = merged_config(base[k], v, locked, here)
        else:
            if here in locked and base.get(k) != v:
                raise ValueError(f"{here} is locked")
            out[k] = v
    return out


def load_config(baseline: str, overlay: str | None = None, locked: tuple[str, ...] = ()) -> dict:
    base = json.loads(Path(baseline).read_text())
    return merged_config(base, json.loads(Path(overlay).read_text()), locked) if overlay else base


def run_id() -> str:
    return uuid.uuid4().hex


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; in local mode one is made where that is unset, on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{run_id()}"


def close_panel(scan: DataFrame, date: str, code: str, close: str, order: list[str]) -> DataFrame:
    """One close a date and code: that of the last row by `order`; missing closes are no rows."""
    return scan.filter(F.col(close).isNotNull()).groupBy(date, code).agg(F.max_by(close, F.struct(*order)).alias(close))


def append_csv(df: DataFrame, path: str) -> None:
    """Rows added to a CSV folder; the commit shows all of them or none."""
    df.write.mode("append").option("header", True).csv(path)


def replace_csv(df: DataFrame, path: str) -> None:
    """A CSV folder replaced by these rows; they may come from the folder itself, so they are written beside it and read again first."""
    beside = f"{path.rstrip('/')}-{run_id()}"
    df.write.option("header", True).csv(beside)
    held = df.sparkSession.read.schema(df.schema).option("header", True).csv(beside)
    held.write.mode("overwrite").option("header", True).csv(path)


def append_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Batches of groups added to a Parquet table under its partition columns, one file a partition and task; readers prune by them."""
    df.repartition(*by).write.mode("append").partitionBy(*by).parquet(path)


def checksums(df: DataFrame, part: str) -> DataFrame:
    """(part, rows, checksum) whatever the order of rows."""
    return df.groupBy(part).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("checksum"))


def backfill(source: DataFrame, path: str, part: str) -> DataFrame:
    """Fill a partitioned table from a source, going on where an earlier run ended: (part, rows, checksum, status).

    A partition whose stored rows have the manifest's checksum is `kept`; one that is missing is `written`, one that
    differs is `repaired`. The manifest is the table of checksums, replaced after the data are in place.
    """
    spark = source.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def there(p: str) -> bool:
        at = jvm.org.apache.hadoop.fs.Path(p)
        return at.getFileSystem(conf).exists(at)

    empty = spark.createDataFrame([], f"`{part}` {source.schema[part].dataType.simpleString()}, rows long, checksum string")
    noted = spark.read.schema(empty.schema).parquet(f"{path}/manifest") if there(f"{path}/manifest") else empty
    held = checksums(spark.read.schema(source.schema).parquet(f"{path}/data"), part) if there(f"{path}/data") else empty
    good = noted.join(held, [part, "rows", "checksum"]).select(part)
    todo = source.join(good, part, "left_anti")
    todo.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(f"{path}/data")
    now = checksums(spark.read.schema(source.schema).parquet(f"{path}/data"), part)
    status = F.when(F.col("__good"), "kept").when(F.col("__noted"), "repaired").otherwise("written")
    report = now.join(good.withColumn("__good", F.lit(True)), part, "left").join(noted.select(part, F.lit(True).alias("__noted")), part, "left")
    report = report.select(part, "rows", "checksum", status.alias("status"))
    told = f"{path}/report-{run_id()}"
    report.write.parquet(told)
    report = spark.read.schema(report.schema).parquet(told)
    report.select(part, "rows", "checksum").write.mode("overwrite").parquet(f"{path}/manifest")
    return report


def put_if_absent(blobs: DataFrame, path: str, payload: str) -> DataFrame:
    """Content-addressed store: payloads not held yet are added once under their SHA-256; returns (key, size, added) of each distinct payload."""
    spark = blobs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    content = F.col(payload).cast("binary")
    new = blobs.filter(F.col(payload).isNotNull()).select(F.sha2(content, 256).alias("key"), content.alias("payload")).dropDuplicates(["key"])
    told = f"{path.rstrip('/')}-put-{run_id()}"
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        held = spark.read.schema("key string, payload binary").parquet(path).select("key", F.lit(True).alias("held"))
        new = new.join(held, "key", "left")
    else:
        new = new.withColumn("held", F.lit(None).cast("boolean"))
    new.select("key", "payload", F.col("held").isNull().alias("added")).write.parquet(told)
    put = spark.read.parquet(told)
    put.filter("added").select("key", "payload").write.mode("append").parquet(path)
    return put.select("key", F.length("payload").cast("long").alias("size"), "added")
