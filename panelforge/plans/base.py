"""Registration of queries with their SQL, and the analog tables that market operators run on.

Supplier days stand for instrument sessions (price = extended price / quantity), nations for
industries, regions for accounts, orders for announcements, users' events for event-store rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelforge.functions.scalar import code_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to so many digits, so that the order of additions does not show; what lies half-way goes up in either engine, NaN stays."""
    scale = 10.0**digits
    return df.select(*[F.when(F.isnan(f.name), F.col(f.name)).otherwise(F.floor(F.col(f.name) * scale + 0.5001) / scale).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema])


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    """Register fn(tables) as a query; doubles: the columns of its SQL to round."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(Tables(spark, sf_dir)), digits)
        if sql is not None:
            cols = doubles.split()
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'floor({c} * 1e{digits} + 0.5001) / 1e{digits} AS {c}' for c in cols)}) FROM ({sql}) AS q" if cols else sql
        return fn

    return add


def panel(t: Tables) -> DataFrame:
    """code, trade_date, open, high, low, close, volume, amount of each supplier day.

    A day has hardly more than one line, so lines are dealt out by code as they are; days, the windows of a code and joins by code need no further exchange or sort.
    """
    lines = t.lineitem.select(code_key(F.col("l_suppkey")).alias("code"), F.date_format("l_shipdate", "yyyyMMdd").alias("trade_date"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").repartition("code")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return (
        lines.withColumns({"px": F.col("l_extendedprice") / F.col("l_quantity"), "ord": order})
        .groupBy("code", "trade_date")
        .agg(F.min_by("px", "ord").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "ord").alias("close"), F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    )


PANEL = """panel AS (
 SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, strftime(l_shipdate, '%Y%m%d') AS trade_date, arg_min(px, ord) AS open, max(px) AS high,
  min(px) AS low, arg_max(px, ord) AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount
 FROM (SELECT *, l_extendedprice / l_quantity AS px, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice, 'e': l_quantity} AS ord FROM lineitem) GROUP BY 1, 2)"""


def members(t: Tables) -> DataFrame:
    """code, industry (nation), account (region): a row a supplier."""
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(code_key(F.col("s_suppkey")).alias("code"), F.col("n_name").alias("industry"), F.col("r_name").alias("account"))


MEMBERS = """members AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, n_name AS industry, r_name AS account
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def universe(t: Tables) -> DataFrame:
    return panel(t).join(members(t), "code")


UNIVERSE = f"{PANEL}, {MEMBERS}, universe AS (SELECT panel.*, industry, account FROM panel JOIN members USING (code))"
RETURNS = f"{UNIVERSE}, returns AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY trade_date), 0) - 1 AS return_1 FROM universe)"


def with_returns(t: Tables) -> DataFrame:
    from panelforge.operators.roll import change

    return universe(t).withColumn("return_1", change("close"))
