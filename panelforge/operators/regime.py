"""Regimes: component scores, three-way states, hysteresis, market trend, scenes, performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.scalar import col, weighted_mean_of_available


def dimension_score(components: list[tuple[str | Column, float]]) -> Column:
    return weighted_mean_of_available(components)


def three_way(score: str | Column, positive: str, neutral: str, negative: str, threshold: float) -> Column:
    s = col(score)
    return F.when(s.isNull(), "unknown").when(s >= threshold, positive).when(s <= -threshold, negative).otherwise(neutral)


def composite(states: list[tuple[str | Column, str, str]], least_coverage: float = 0.7, balance: float = 0.35) -> Column:
    """risk_on, risk_off or mixed by the mean of +1/-1 votes; unknown below the coverage. states: (state, good value, bad value)."""
    n = len(states)
    known = sum((F.when(col(s) != "unknown", 1).otherwise(0) for s, _, _ in states), F.lit(0))
    votes = sum((F.when(col(s) == good, 1).when(col(s) == bad, -1).otherwise(0) for s, good, bad in states), F.lit(0))
    mean = votes / known
    return F.when(known / n < least_coverage, "unknown").when(mean >= balance, "risk_on").when(mean <= -balance, "risk_off").otherwise("mixed")


def hysteresis(df: DataFrame, candidate: str, by: list[str], date: str, persistence: int) -> DataFrame:
    """The state after each row: the first known candidate, then a candidate once it stands in `persistence` known rows in a row; unknown rows hold the state and the count.

    Known rows form runs of equal candidates; a row confirms its candidate if it is the first known one or far enough into its run, and the
    state is the last confirmed candidate: windows over one order, so a long series costs its sort.
    """
    w = W.partitionBy(*by).orderBy(date, candidate)
    c = F.when(F.col(candidate) != "unknown", F.col(candidate))
    d = df.withColumn("__c", c).withColumn("__p", F.last("__c", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    d = d.withColumn("__run", F.sum((F.col("__c").isNotNull() & ~F.col("__c").eqNullSafe(F.col("__p"))).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    place = F.count("__c").over(W.partitionBy(*by, "__run").orderBy(date, candidate).rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("__k", F.when(F.col("__p").isNull() | (place >= persistence), F.col("__c")))
    return d.withColumn("state", F.last("__k", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__c", "__p", "__run", "__k")


def market_regime(df: DataFrame, close: str, by: list[str], date: str, average: int = 200, momentum: int = 60, band: float = 0.05) -> DataFrame:
    """bull above the long average with momentum over the band, bear below it with momentum under -band, else sideways; unknown without history."""
    w = W.partitionBy(*by).orderBy(date)
    over = w.rowsBetween(-(average - 1), 0)
    sma = F.when(F.count(close).over(over) >= average, F.avg(close).over(over))
    mom = F.col(close) / F.lag(close, momentum).over(w) - 1
    return df.withColumn("__a", sma).withColumn("__m", mom).withColumn("regime", F.when(F.col("__a").isNull() | F.col("__m").isNull(), "unknown").when((F.col(close) > F.col("__a")) & (F.col("__m") > band), "bull").when((F.col(close) < F.col("__a")) & (F.col("__m") < -band), "bear").otherwise("sideways")).drop("__a", "__m")


def scenes(daily: DataFrame, date: str, vol: str, breadth: str, history: int, quantile: float) -> DataFrame:
    """stress where volatility is above the trailing quantile of the rows before, expansion where breadth is over a half, else range. daily has a row a date."""
    before = W.orderBy(date).rowsBetween(-history, -1)
    return daily.withColumn("__q", F.percentile(vol, quantile).over(before)).withColumn("scene", F.when(F.col("__q").isNull(), "unknown").when(F.col(vol) > F.col("__q"), "stress").when(F.col(breadth) > 0.5, "expansion").otherwise("range")).drop("__q")


def regime_performance(df: DataFrame, regime: str, ret: str) -> DataFrame:
    """Days, mean and compounded return of each regime."""
    return df.groupBy(regime).agg(F.count(ret).alias("n"), F.avg(ret).alias("mean"), (F.exp(F.sum(F.log1p(ret))) - 1).alias("compounded"))
