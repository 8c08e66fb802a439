"""Time-series operators: rows of one code in order; windows count sessions, not days."""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.scalar import col, corr

CODE, DATE = "code", "trade_date"


def series(code: str = CODE, date: str = DATE):
    return W.partitionBy(code).orderBy(date)


def last_n(n: int, w=None):
    return (w or series()).rowsBetween(-(n - 1), 0)


def so_far(w=None):
    return (w or series()).rowsBetween(W.unboundedPreceding, 0)


def rolling(fn, x: str | Column, n: int, least: int | None = None, w=None) -> Column:
    """fn over the last n rows where at least `least` (n by default) values are not null."""
    over = last_n(n, w)
    return F.when(F.count(col(x)).over(over) >= (n if least is None else least), fn(col(x)).over(over))


def mean(x, n, least=None, w=None):
    return rolling(F.avg, x, n, least, w)


def total(x, n, least=None, w=None):
    return rolling(F.sum, x, n, least, w)


def std(x, n, least=None, w=None):
    return rolling(F.stddev_samp, x, n, least, w)


def median(x, n, least=None, w=None):
    return rolling(lambda c: F.percentile(c, 0.5), x, n, least, w)


def change(x: str | Column, n: int = 1, w=None) -> Column:
    """x / x n rows ago - 1; null where that is 0 or missing."""
    before = F.lag(col(x), n).over(w or series())
    return F.when(before != 0, col(x) / before - 1)


def rolling_percentile(x: str | Column, n: int, least: int, w=None) -> Column:
    """Share of the last n non-null values that are at most the current one."""
    values = F.collect_list(col(x)).over(last_n(n, w))
    share = F.size(F.filter(values, lambda v: v <= col(x))) / F.size(values)
    return F.when(col(x).isNotNull() & (F.size(values) >= least), share)


def rolling_corr(x: str | Column, y: str | Column, n: int, least: int | None = None, w=None, flat=None) -> Column:
    """Correlation over the last n rows where at least `least` (n by default) have both; `flat` where one side does not vary."""
    both, over = F.when(col(x).isNotNull() & col(y).isNotNull(), 1), last_n(n, w)
    return F.when(F.count(both).over(over) >= (least or n), corr(x, y, over, flat))


def since(event: Column, w=None) -> Column:
    """Rows since the event was last true, null before the first."""
    w = w or series()
    n = F.row_number().over(w)
    return n - F.last(F.when(event, n), ignorenulls=True).over(so_far(w))


def drawdown(x: str | Column, w=None) -> Column:
    return col(x) / F.max(col(x)).over(so_far(w)) - 1


def over_series(df: DataFrame, by: list[str], order: str, x: str, out: str, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """df with `out`: fn of each group's values of x in order (ties by value), missing ones as NaN; NaN in its result is null.

    A group's rows are one array (a history is bounded by its sessions); only its values reach Python, other columns of any type stay
    in Spark.
    """

    @F.pandas_udf("array<double>")
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda v: fn(np.array(v, float)))

    row = F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"))
    held = df.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("__s"))
    held = held.select(F.transform("__s", lambda v: v["r"]).alias("__r"), each(F.transform("__s", lambda v: v["x"])).alias("__z"))
    return held.select(F.inline(F.arrays_zip("__r", "__z"))).select("__r.*", F.when(~F.isnan("__z"), F.col("__z")).alias(out))


def robust_scores(values: np.ndarray, least: int) -> np.ndarray:
    """(x - median) / (1.4826 MAD) of each value among those up to it. Values are kept in order; the k nearest to the median are neighbours
    there, so their farthest is found by bisection."""
    held: list[float] = []
    out = np.full(len(values), np.nan)
    mean = square = 0.0

    def kth(m: float, k: int) -> float:
        low, high = 0, len(held) - k
        while low < high:
            mid = (low + high) // 2
            if m - held[mid] > held[mid + k] - m:
                low = mid + 1
            else:
                high = mid
        return max(m - held[low], held[low + k - 1] - m)

    for i, v in enumerate(values.tolist()):
        if v != v:
            continue
        insort(held, v)
        n = len(held)
        mean, before = mean + (v - mean) / n, mean
        square += (v - before) * (v - mean)
        if n < least:
            out[i] = 0.0
            continue
        half = n // 2
        m = held[half] if n % 2 else (held[half - 1] + held[half]) / 2
        mad = kth(m, half + 1) if n % 2 else (kth(m, half) + kth(m, half + 1)) / 2
        scale = 1.4826 * mad if mad > 1e-12 else math.sqrt(square / n)
        out[i] = min(max((v - m) / scale, -5.0), 5.0) if scale > 1e-12 else 0.0
    return out


def expanding_robust_z(df: DataFrame, x: str, out: str, by: list[str], date: str, least: int = 3) -> DataFrame:
    """(x - median) / (1.4826 MAD) over all values so far, the standard deviation where MAD is 0, clipped to +-5; 0 with fewer than `least` values."""
    return over_series(df, by, date, x, out, lambda v: robust_scores(v, least))


def residual_momentum(panel: DataFrame, ret: str, market: str, industry: str, window: int, least: int, skip: int, ridge: float = 1e-8, code: str = CODE, date: str = DATE) -> DataFrame:
    """Ex-ante residuals of ret on [1, market, industry] with coefficients of the `window` rows before, and their momentum.

    Coefficients solve 3 x 3 normal equations of rolling sums by Cramer's rule; today's row is not in them.
    `residual_momentum`: sum of residuals from `skip` rows ago over window - skip + 1 rows / (their deviation x root of their number).
    """
    w = W.partitionBy(code).orderBy(date)
    before = w.rowsBetween(-window, -1)
    ok = F.col(ret).isNotNull() & F.col(market).isNotNull() & F.col(industry).isNotNull()
    y, a, b = (F.when(ok, F.col(c)) for c in (ret, market, industry))
    sums = {"n": F.count(y), "sa": F.sum(a), "sb": F.sum(b), "sy": F.sum(y), "saa": F.sum(a * a), "sbb": F.sum(b * b), "sab": F.sum(a * b), "say": F.sum(a * y), "sby": F.sum(b * y)}
    d = panel
    for k, v in sums.items():
        d = d.withColumn(f"__{k}", v.over(before))
    g = lambda k: F.col(f"__{k}")
    m = [[g("n") + ridge, g("sa"), g("sb")], [g("sa"), g("saa") + ridge, g("sab")], [g("sb"), g("sab"), g("sbb") + ridge]]
    v = [g("sy"), g("say"), g("sby")]

    def det(x):
        return x[0][0] * (x[1][1] * x[2][2] - x[1][2] * x[2][1]) - x[0][1] * (x[1][0] * x[2][2] - x[1][2] * x[2][0]) + x[0][2] * (x[1][0] * x[2][1] - x[1][1] * x[2][0])

    d = d.withColumn("__det", det(m))
    for k in range(3):
        d = d.withColumn(f"__b{k}", det([[v[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / F.col("__det"))
    res = F.col(ret) - F.col("__b0") - F.col("__b1") * F.col(market) - F.col("__b2") * F.col(industry)
    d = d.withColumn("residual", F.when(ok & (g("n") >= least) & (F.abs("__det") > 0), res))
    size = window - skip + 1
    span = w.rowsBetween(-(window), -skip)
    n = F.count("residual").over(span)
    sd = F.stddev_samp("residual").over(span)
    d = d.withColumn("residual_momentum", F.when((n >= least) & (sd > 1e-9), F.sum("residual").over(span) / (sd * math.sqrt(size))))
    return d.drop(*[c for c in d.columns if c.startswith("__")])


def last_metrics(df: DataFrame, short: str, long: str, ret: str, amount: str, code: str = CODE, date: str = DATE) -> DataFrame:
    """Per code the momenta of its last row, the deviation of its last 60 returns and the mean of its last 20 amounts."""
    d = df.withColumn("__i", F.row_number().over(W.partitionBy(code).orderBy(F.col(date).desc())))
    latest = lambda c: F.max(F.when(F.col("__i") == 1, F.col(c)))
    return d.filter("__i <= 60").groupBy(code).agg(latest(short).alias("momentum_20"), latest(long).alias("momentum_60"), F.stddev_samp(ret).alias("volatility_60"), F.avg(F.when(F.col("__i") <= 20, F.col(amount))).alias("average_amount_20"))


def candles(prices: DataFrame, scores: DataFrame, top: int, rows: int, code: str = CODE, date: str = DATE) -> DataFrame:
    """The last `rows` rows of the `top` codes by score, ties by code."""
    best = scores.orderBy(F.desc("score"), code).limit(top).select(code)
    return prices.join(best, code, "left_semi").withColumn("__i", F.row_number().over(W.partitionBy(code).orderBy(F.col(date).desc()))).filter(F.col("__i") <= rows).drop("__i")
