"""How many names a strategy can hold: sensitivity of its selections to the number of names."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.operators.lineage import components

#: Share of the money that is invested, deepest drawdown a recommendation may have, names beyond the selection that must be eligible.
INVESTED, DEEPEST, SPARE = 0.98, -0.25, 1


def selections(ranked: DataFrame, top_ns: list[int], by: list[str], date: str, code: str, index: str, score: str, max_per_index: int = 1, max_weight: float = 0.2) -> DataFrame:
    """(by, top_n, date, code, pick, weight, eligible): the best top_n of each date with at most max_per_index of an index, by score (ties by code).

    One ranking serves all sizes: a row is repeated only for the sizes that select it. Rows without a score are not eligible.
    """
    best = [F.col(score).desc(), F.col(code)]
    d = ranked.filter(F.col(score).isNotNull()).withColumn("eligible", F.count(F.lit(1)).over(W.partitionBy(*by, date)))
    d = d.withColumn("__k", F.row_number().over(W.partitionBy(*by, date, index).orderBy(*best))).filter(F.col("__k") <= max_per_index)
    d = d.withColumn("pick", F.row_number().over(W.partitionBy(*by, date).orderBy(*best))).filter(F.col("pick") <= max(top_ns))
    sizes = F.filter(F.array(*[F.lit(n) for n in sorted(set(top_ns))]), lambda n: n >= F.col("pick"))
    d = d.withColumn("top_n", F.explode(sizes))
    return d.select(*by, "top_n", date, code, "pick", F.least(F.lit(INVESTED) / F.col("top_n"), F.lit(max_weight)).alias("weight"), "eligible")


def ever_selected(returns: DataFrame, ranked: DataFrame, top_ns: list[int], by: list[str], date: str, code: str, index: str, score: str, max_per_index: int = 1) -> DataFrame:
    """Returns of the codes that some size selects on some date: only their pairs can join groups, and their number is bounded by dates and sizes, however many codes there are."""
    best = selections(ranked, [max(top_ns)], by, date, code, index, score, max_per_index)  # holds what smaller sizes select
    return returns.join(best.select(code).distinct(), code, "left_semi")


def correlated(selected: DataFrame, pairs: DataFrame, by: list[str], code: str, least: float) -> DataFrame:
    """(by, top_n, codes, clusters): codes that a size ever selects and the connected groups among them; pairs: a, b, corr. A code alone is a group."""
    keys = [*by, "top_n"]
    nodes = selected.select(*keys, F.col(code).alias("__c")).distinct()
    name = lambda c: F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys], F.col(c))
    near = pairs.filter(F.col("corr") >= least).select("a", "b")
    edges = nodes.withColumnRenamed("__c", "a").join(near, "a").join(nodes.withColumnRenamed("__c", "b"), [*keys, "b"]).select(name("a").alias("a"), name("b").alias("b"))
    group = components(edges, "a", "b")
    d = nodes.withColumn("node", name("__c")).join(group, "node", "left")
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("codes"), F.count_distinct(F.coalesce("component", "node")).alias("clusters"))


def study(ranked: DataFrame, returns: DataFrame, pairs: DataFrame, top_ns: list[int], by: list[str], date: str, code: str, index: str, score: str, ret: str, periods: int, cost: float = 0.001, max_per_index: int = 1, max_weight: float = 0.2, least_corr: float = 0.8) -> DataFrame:
    """A row a combination of `by` and size: dates, average_eligible, annual_return, volatility, sharpe, max_drawdown, turnover, codes, clusters, and whether it is recommended.

    returns: date, code, ret until the next signal. Weights are equal; turnover is half of the absolute weight changes; a period's return is less `cost`
    a unit of turnover. Recommended is the size with enough eligible names and no drawdown deeper than DEEPEST that has the best Sharpe
    ratio, then the most clusters, the least turnover and the fewest names; none where no size passes.
    """
    keys = [*by, "top_n"]
    sel = selections(ranked, top_ns, by, date, code, index, score, max_per_index, max_weight)
    dates = ranked.select(*by, date).distinct().withColumn("__i", F.row_number().over(W.partitionBy(*by).orderBy(date)))
    held = sel.join(dates, [*by, date]).join(returns.select(date, code, F.col(ret).alias("__r")), [date, code], "left")
    stay = held.select(*keys, code, (F.col("__i") + 1).alias("__i"), F.col("weight").alias("__before"))
    both = held.select(*keys, code, "__i", "weight").join(stay, [*keys, code, "__i"], "full_outer")
    moved = both.groupBy(*keys, "__i").agg((F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("__before", F.lit(0.0)))) / 2).alias("__t"))
    gross = held.groupBy(*keys, "__i").agg(F.sum(F.col("weight") * F.coalesce("__r", F.lit(0.0))).alias("__g"), F.max("eligible").alias("__e"))
    d = gross.join(moved, [*keys, "__i"]).withColumn("__n", F.col("__g") - F.col("__t") * cost)
    w = W.partitionBy(*keys).orderBy("__i")
    d = d.withColumn("__v", F.exp(F.sum(F.log1p(F.greatest("__n", F.lit(-0.999999)))).over(w)))
    d = d.withColumn("__d", F.col("__v") / F.greatest(F.max("__v").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(1.0)) - 1)
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("dates"),
        F.avg("__e").alias("average_eligible"),
        (F.avg("__n") * periods).alias("annual_return"),
        (F.stddev_samp("__n") * math.sqrt(periods)).alias("volatility"),
        F.min("__d").alias("max_drawdown"),
        F.avg("__t").alias("turnover"),
    ).withColumn("sharpe", F.col("annual_return") / F.nullif(F.col("volatility"), F.lit(0.0)))
    g = g.join(correlated(sel, pairs, by, code, least_corr), keys)
    passed = (F.col("average_eligible") >= F.col("top_n") + SPARE) & (F.col("max_drawdown") >= DEEPEST)
    place = F.row_number().over(W.partitionBy(*by, "__ok").orderBy(F.coalesce(F.round("sharpe", 9), F.lit(-999.0)).desc(), F.col("clusters").desc(), F.round("turnover", 9), "top_n"))
    return g.withColumn("__ok", passed).withColumn("recommended", F.col("__ok") & (place == 1)).drop("__ok")
