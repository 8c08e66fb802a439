"""Account performance, turnover, FIFO round trips, attribution and sanity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.scalar import safe_ratio, truth


def account_performance(nav: DataFrame, account: str, date: str, value: str, benchmark: str | None = None, risk_free: float = 0.0, year: int = 252) -> DataFrame:
    """Per account: annual mean and deviation (ddof 1), downside deviation (ddof 0, negative excess only), Sharpe, Sortino, cumulative return,
    deepest drawdown with its dates, and against a benchmark excess, tracking error and information ratio."""
    w = W.partitionBy(account).orderBy(date)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    d = nav.withColumn("__r", F.when(F.lag(value).over(w) != 0, F.col(value) / F.lag(value).over(w) - 1))
    d = d.withColumn("__peak", F.max(value).over(run)).withColumn("__dd", F.col(value) / F.col("__peak") - 1).withColumn("__peak_date", F.max_by(date, F.struct(value, date)).over(run))
    if benchmark:
        d = d.withColumn("__b", F.when(F.lag(benchmark).over(w) != 0, F.col(benchmark) / F.lag(benchmark).over(w) - 1)).withColumn("__x", F.col("__r") - F.col("__b"))
    daily = risk_free / year
    negative = F.when(F.col("__r") < daily, F.col("__r") - daily)
    aggs = [F.count("__r").alias("days"), (F.avg("__r") * year).alias("annual_return"), (F.stddev_samp("__r") * year**0.5).alias("volatility"), (F.stddev_pop(negative) * year**0.5).alias("downside"), (F.max_by(value, date) / F.min_by(value, date) - 1).alias("cumulative"), F.min("__dd").alias("max_drawdown"), F.min_by("__peak_date", F.struct("__dd", date)).alias("peak_date"), F.min_by(date, F.struct("__dd", date)).alias("trough_date")]
    if benchmark:
        aggs += [(F.avg("__x") * year).alias("excess"), (F.stddev_samp("__x") * year**0.5).alias("tracking_error")]
    out = d.groupBy(account).agg(*aggs)
    out = out.withColumn("sharpe", safe_ratio(F.col("annual_return") - risk_free, "volatility")).withColumn("sortino", safe_ratio(F.col("annual_return") - risk_free, "downside"))
    return out.withColumn("information_ratio", safe_ratio("excess", "tracking_error")) if benchmark else out


def weekly_turnover(trades: DataFrame, nav: DataFrame, account: str, date: str, gross: str, value: str) -> DataFrame:
    """Per account and Monday-to-Sunday week: traded value over the NAV last seen at or before the week's start, else the first NAV."""
    from panelforge.operators.pit import asof_join

    weeks = trades.withColumn("week", F.date_trunc("week", F.col(date)).cast("date")).groupBy(account, "week").agg(F.sum(F.abs(gross)).alias("traded"))
    first = nav.groupBy(account).agg(F.min_by(value, date).alias("__first"))
    at = asof_join(weeks, nav.withColumn("__d", F.col(date).cast("date")), [account], "week", "__d", [value])
    return at.join(first, account).withColumn("base", F.coalesce(value, "__first")).withColumn("turnover", safe_ratio("traded", "base")).select(account, "week", "traded", "base", "turnover")


def fifo_matches(trades: DataFrame, keys: list[str], order: list[str], side: str, shares: str, price: str, date: str) -> DataFrame:
    """FIFO lots as overlaps of cumulative shares: every buy and sell is an interval [before, after) of its side's running
    total; a sell closes the buys it overlaps. Valid while sells never exceed what was bought; what is sold beyond stays unmatched.

    Intervals meet by key; both sides' shares are cut into blocks of equal size so that the range join has an equi key.
    """
    w = W.partitionBy(*keys, side).orderBy(*order)
    t = trades.withColumn("__end", F.sum(shares).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__start", F.col("__end") - F.col(shares))
    block = F.percentile_approx(shares, 0.9).over(W.partitionBy(*keys)) * 4
    t = t.withColumn("__block", F.greatest(block, F.lit(1.0)))
    t = t.withColumn("__slot", F.explode(F.sequence(F.floor(F.col("__start") / F.col("__block")), F.floor((F.col("__end") - 1e-9) / F.col("__block")))))
    kept = [*keys, "__slot", "__start", "__end", price, date]
    b = t.filter(F.col(side) == "buy").select(*[F.col(c).alias(f"b_{c}" if c not in (*keys, "__slot") else c) for c in kept])
    s = t.filter(F.col(side) == "sell").select(*[F.col(c).alias(f"s_{c}" if c not in (*keys, "__slot") else c) for c in kept])
    low, high = F.greatest("b___start", "s___start"), F.least("b___end", "s___end")
    m = b.join(s, [*keys, "__slot"]).withColumn("__low", low).withColumn("__high", high).filter("__high > __low").dropDuplicates([*keys, "__low", "__high"])
    return m.select(*keys, F.col(f"b_{date}").alias("buy_date"), F.col(f"s_{date}").alias("sell_date"), (F.col("__high") - F.col("__low")).alias("shares"), F.col(f"b_{price}").alias("buy_price"), F.col(f"s_{price}").alias("sell_price")).withColumn("pnl", (F.col("sell_price") - F.col("buy_price")) * F.col("shares"))


def round_trips(matches: DataFrame, keys: list[str]) -> DataFrame:
    return matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("lots"), F.sum("shares").alias("shares"), F.sum("pnl").alias("pnl"), F.avg((F.col("pnl") > 0).cast("int")).alias("win_rate"), F.avg(F.datediff("sell_date", "buy_date")).alias("holding_days"))


def relative_wealth(df: DataFrame, account: str, date: str, value: str, benchmark: str) -> DataFrame:
    """Portfolio over benchmark wealth, both from 1 on, and its drawdown."""
    w = W.partitionBy(account).orderBy(date)
    first = w.rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("relative", (F.col(value) / F.first(value).over(first)) / (F.col(benchmark) / F.first(benchmark).over(first)))
    return d.withColumn("relative_drawdown", F.col("relative") / F.max("relative").over(first) - 1)


def season_nav(df: DataFrame, account: str, date: str, value: str, benchmark: str, start: str) -> DataFrame:
    """Returns since `start`: the anchor is the last row at or before it, else the first row."""
    anchor = df.groupBy(account).agg(F.coalesce(F.max_by(value, F.when(F.col(date) <= start, F.col(date))), F.min_by(value, date)).alias("__v"), F.coalesce(F.max_by(benchmark, F.when(F.col(date) <= start, F.col(date))), F.min_by(benchmark, date)).alias("__b"))
    return df.filter(F.col(date) >= start).join(anchor, account).withColumn("ret", F.col(value) / F.col("__v") - 1).withColumn("benchmark_ret", F.col(benchmark) / F.col("__b") - 1).drop("__v", "__b")


def allocations(df: DataFrame, by: list[str], label: str, value: str) -> DataFrame:
    """Share of each label in its group, largest first."""
    g = df.groupBy(*by, label).agg(F.sum(value).alias("value"))
    total = F.sum("value").over(W.partitionBy(*by))
    return g.withColumn("weight", safe_ratio("value", total)).withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.col("value").desc(), label)))


def overlap(a: DataFrame, b: DataFrame, by: list[str], name: str, weight: str) -> DataFrame:
    """Jaccard of the names and weighted overlap (sum of minima over sum of maxima) of two books."""
    x, y = a.select(*by, name, F.col(weight).alias("__a")), b.select(*by, name, F.col(weight).alias("__b"))
    j = x.join(y, [*by, name], "full_outer")
    za, zb = F.coalesce("__a", F.lit(0.0)), F.coalesce("__b", F.lit(0.0))
    both = (F.col("__a").isNotNull() & F.col("__b").isNotNull()).cast("int")
    return j.groupBy(*by).agg((F.sum(both) / F.count(F.lit(1))).alias("jaccard"), safe_ratio(F.sum(F.least(za, zb)), F.sum(F.greatest(za, zb))).alias("weighted_overlap"))


def nav_jumps(nav: DataFrame, account: str, date: str, value: str, warn: float = 0.05, critical: float = 0.10) -> DataFrame:
    """Days whose NAV moved by at least `warn`, with their severity."""
    move = F.abs(F.col(value) / F.lag(value).over(W.partitionBy(account).orderBy(date)) - 1)
    return nav.withColumn("move", move).filter(F.col("move") >= warn).withColumn("severity", F.when(F.col("move") >= critical, "critical").otherwise("warn"))


def concentration(df: DataFrame, by: list[str], value: str, limit: float) -> DataFrame:
    """Largest share of positive totals and whether it is over the limit."""
    positive = F.when(F.col(value) > 0, F.col(value)).otherwise(0.0)
    return df.groupBy(*by).agg(F.sum(positive).alias("__t"), F.max(positive).alias("__m")).withColumn("share", safe_ratio("__m", "__t")).withColumn("too_concentrated", truth(F.col("share") > limit)).drop("__t", "__m")


def attribution(exposures: DataFrame, returns: DataFrame, keys: list[str], factor: str) -> DataFrame:
    """Contribution of each factor: weight x exposure x factor return; factors without a return are listed as missing, not invented.

    exposures: keys, factor, weight, exposure; returns: date key among keys, factor, factor_return.
    """
    shared = [k for k in keys if k in returns.columns]
    j = exposures.join(returns, [*shared, factor], "left").withColumn("__c", F.col("weight") * F.col("exposure") * F.col("factor_return"))
    return j.groupBy(*keys).agg(F.coalesce(F.sum("__c"), F.lit(0.0)).alias("explained"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("__c").isNull(), F.col(factor)))), "|").alias("missing"))


def lookthrough(positions: DataFrame, constituents: DataFrame, fund: str, by: list[str], groups: list[str]) -> DataFrame:
    """Exposure through funds: position weight x constituent weight, summed by group."""
    j = positions.join(constituents, fund)
    return j.groupBy(*by, *groups).agg(F.sum(F.col("position_weight") * F.col("constituent_weight")).alias("exposure"))


def first_or(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def backtest_metrics(nav: DataFrame, account: str, date: str, value: str, benchmark: str, year: int = 252) -> DataFrame:
    """Metrics of all accounts together: cumulative and annual return, volatility, Sharpe, deepest drawdown, information ratio against the
    benchmarks scaled to each account's first value. Sums a date first; what is ordered is a row a date."""
    first = nav.groupBy(account).agg(F.min_by(value, date).alias("__v0"), F.min_by(benchmark, date).alias("__b0"))
    daily = nav.join(first, account).groupBy(date).agg(F.round(F.sum(value), 6).alias("p"), F.round(F.sum(F.col("__v0") * F.col(benchmark) / F.col("__b0")), 6).alias("q"))
    w = W.orderBy(date)
    d = daily.withColumn("r", F.col("p") / F.lag("p").over(w) - 1).withColumn("b", F.col("q") / F.lag("q").over(w) - 1).withColumn("dd", F.col("p") / F.max("p").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    g = d.agg((F.max_by("p", date) / F.min_by("p", date) - 1).alias("cum_return"), (F.pow(1 + F.avg("r"), F.lit(year)) - 1).alias("annual_return"), (F.stddev_samp("r") * year**0.5).alias("volatility"), F.min("dd").alias("max_drawdown"), (F.avg(F.col("r") - F.col("b")) / F.nullif(F.stddev_samp(F.col("r") - F.col("b")), F.lit(0.0)) * year**0.5).alias("information_ratio"))
    return g.withColumn("sharpe", safe_ratio("annual_return", "volatility"))
