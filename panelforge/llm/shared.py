"""What several operators of this package share: folders, written tables, blocks of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: Bytes of text that one numpy pass handles; a single longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Base of polynomial hashes modulo 2^64.
BASE = 0x100000001B3


#: For files whose rows are blobs: their writer looks at the size of pages and row groups after every row. By default it first looks after
#: a hundred, so a page, with its compressor's buffers outside the heap and the vectors of its reader, would hold all chunks of a task.
BLOB_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset one is made in local mode (tests), and on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: lineage is cut, lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """What one run writes in between, its rows blobs: tables of the shared folder that go when the run ends, however it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        self.paths.append(path)
        df.write.options(**BLOB_ROWS).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, name: str) -> None:
        """A catalog table with files in the shared folder."""
        self.tables.append(name)
        self.paths.append(self.spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Location'").first()["data_type"])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


#: Bytes of rows that go to Python at once in steps that an operator runs itself.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES for what runs inside: the steps that an operator writes, not those that it leaves to its caller."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


_KEPT: dict[str, object] = {}


def kept(key: str, build: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task, one thing at a time: another operator's goes first."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]  # type: ignore[return-value]


def release() -> None:
    """Give back what an operator before this one keeps in the worker."""
    _KEPT.clear()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string, null text as empty); other columns, whatever their names, do not pass."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def as_binary(c: Column) -> Column:
    return c.cast("binary")


def sliced(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `limit` bytes of `column`, a longer row alone."""
    col = batch.column(batch.schema.get_field_index(column))
    ends = offsets(col)
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield batch.slice(first, last - first)
        first = last


def offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, one more than rows."""
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if len(col) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, offsets from 0) without a copy; the column holds no nulls."""
    ends = offsets(col)
    data = col.buffers()[2] if len(col) else None
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


def record_batch(schema: str | pa.Schema, **columns) -> pa.RecordBatch:
    """Columns in the order given; numpy arrays and lists become arrow arrays of the schema's types."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(k).type) for k, c in columns.items()], schema=schema)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, up to n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, (1 << 18) + 64)
        _POWERS[:] = [_powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)]
    return _POWERS[0][:n], _POWERS[1][:n]
