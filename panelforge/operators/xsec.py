"""Cross-sectional operators: one date (and group) at a time."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.scalar import clip, col


def pct_rank(x: str | Column, by: list) -> Column:
    """Average-tie percentile rank among the non-null values of the group; null stays null.

    Nulls sort last, so they stand behind every rank; with ties the average rank is half of the first rank and of the number of
    rows up to the last tie. Only windows of the group are used: all ranks of a group share one exchange.
    """
    x, w = col(x), W.partitionBy(*by)
    order = w.orderBy(x.asc_nulls_last())
    return F.when(x.isNotNull(), (F.rank().over(order) + F.count(F.lit(1)).over(order)) / 2 / F.count(x).over(w))


def centered_rank(df: DataFrame, x: str, by: list[str], out: str) -> DataFrame:
    """pct_rank minus its group mean."""
    ranked = df.withColumn(out, pct_rank(x, by))
    return ranked.withColumn(out, F.col(out) - F.avg(out).over(W.partitionBy(*by)))


def winsorize(df: DataFrame, x: str, by: list[str], low: float, high: float, out: str) -> DataFrame:
    """Clip to the group's linear quantiles."""
    q = F.percentile(x, F.array(F.lit(low), F.lit(high))).over(W.partitionBy(*by))
    return df.withColumn("__q", q).withColumn(out, clip(x, F.col("__q")[0], F.col("__q")[1])).drop("__q")


def zscore(x: str | Column, by: list) -> Column:
    """Population z-score; 0 where the group does not vary."""
    x, w = col(x), W.partitionBy(*by)
    sd = F.stddev_pop(x).over(w)
    return F.when(x.isNotNull(), F.when(sd > 0, (x - F.avg(x).over(w)) / sd).otherwise(0.0))


def neutralize(x: str | Column, by: list, label: str, unclassified: str = "未分类") -> Column:
    """Minus the mean of the label's group; blank and null labels are one group."""
    group = F.when(F.trim(F.col(label)) != "", F.col(label)).otherwise(unclassified)
    return col(x) - F.avg(col(x)).over(W.partitionBy(*by, group))


def date_balanced_weights(df: DataFrame, date: str, out: str = "weight") -> DataFrame:
    return df.withColumn(out, 1.0 / F.count(F.lit(1)).over(W.partitionBy(date)))


def recency_weights(df: DataFrame, date: str, half_life: float, out: str = "weight") -> DataFrame:
    """0.5^(age in dates / half life) / rows of the date, scaled to mean 1. Dates are ranked in a table of dates only."""
    dates = df.groupBy(date).agg(F.count(F.lit(1)).alias("__n"))
    aged = dates.withColumn("__age", F.row_number().over(W.orderBy(F.col(date).desc())) - 1)
    raw = aged.withColumn("__w", F.pow(F.lit(0.5), F.col("__age") / half_life) / F.col("__n"))
    total = raw.agg((F.sum(F.col("__w") * F.col("__n")) / F.sum("__n")).alias("__mean"))
    return df.join(raw.crossJoin(total).select(date, (F.col("__w") / F.col("__mean")).alias(out)), date)


def relevance_bins(pct: str | Column, bins: int) -> Column:
    return F.least(F.floor(col(pct) * bins), F.lit(bins - 1)).cast("int")


def regression_residual(df: DataFrame, y: str, x: str, by: list[str], out: str, least: int = 3) -> DataFrame:
    """Residual of y on [1, x] in each group; with fewer than `least` pairs or a constant x minus the mean."""
    w = W.partitionBy(*by)
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    yy, xx = F.when(both, F.col(y)), F.when(both, F.col(x))
    n, sd = F.count(yy).over(w), F.stddev_pop(xx).over(w)
    slope, icept = F.regr_slope(yy, xx).over(w), F.regr_intercept(yy, xx).over(w)
    return df.withColumn(out, F.when(~both, None).when((n >= least) & (sd > 1e-12), F.col(y) - icept - slope * F.col(x)).otherwise(F.col(y) - F.avg(yy).over(w)))


def neutralize_scores(df: DataFrame, date: str, score: str, numeric: list[str], label: str, out: str) -> DataFrame:
    """Residual of the score on [1, numeric columns (median-imputed), label dummies] per date by least squares, recentred; under 3 rows minus the mean."""
    import numpy as np

    kinds = df.withColumn(out, F.lit(0.0)).schema

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[score].astype(float)
        ok = y.notna()
        res = y - y[ok].mean()
        if ok.sum() >= 3:
            x = pdf.loc[ok, numeric].astype(float)
            x = x.fillna(x.median()).fillna(0.0)
            d = pd.get_dummies(pdf.loc[ok, label].fillna("未分类"), drop_first=True).astype(float)
            a = np.column_stack([np.ones(len(x)), x.to_numpy(), d.to_numpy()])
            beta = np.linalg.lstsq(a, y[ok].to_numpy(), rcond=None)[0]
            r = y[ok].to_numpy() - a @ beta
            res = pd.Series(np.nan, index=pdf.index)
            res[ok] = r - r.mean()
        return pdf.assign(**{out: res})

    return df.groupBy(date).applyInPandas(fit, kinds)


def hash_quota(df: DataFrame, date: str, keys: list[str], quota: int, seed: int = 0) -> DataFrame:
    """At most `quota` rows a date: those with the least MD5 of keys and seed."""
    h = F.md5(F.concat_ws("|", *keys, F.lit(str(seed))))
    return df.withColumn("__n", F.row_number().over(W.partitionBy(date).orderBy(h, *keys))).filter(F.col("__n") <= quota).drop("__n")


def long_ranks(df: DataFrame, keys: list[str], features: list[str], by: list[str]) -> DataFrame:
    """Centered ranks of many features in long form (keys, feature, value, rank): one shuffle and sort for all of them."""
    long = df.unpivot(keys, features, "feature", "value")
    return centered_rank(long, "value", [*by, "feature"], "rank")


def breadth(df: DataFrame, date: str, label: str, ret: str) -> DataFrame:
    """Per date and label: median return and the share of rows above 0 (missing counts as not above)."""
    return df.groupBy(date, label).agg(F.percentile(ret, 0.5).alias("median"), F.avg(F.coalesce((F.col(ret) > 0).cast("int"), F.lit(0))).alias("breadth"), F.count(F.lit(1)).alias("n"))


def select_with_cap(df: DataFrame, by: list[str], group: str, score: str, tie: str, top_n: int, cap: int) -> DataFrame:
    """Top n per `by` with at most `cap` of a group, refilled by rank from the skipped rows; `picked` says how."""
    order = [F.col(score).desc(), F.col(tie)]
    ranked = df.withColumn("__g", F.row_number().over(W.partitionBy(*by, group).orderBy(*order)))
    ranked = ranked.withColumn("__over", (F.col("__g") > cap).cast("int"))
    ranked = ranked.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy("__over", *order)))
    return ranked.filter(F.col("__n") <= top_n).withColumn("picked", F.when(F.col("__over") == 0, "rank").otherwise("refill")).withColumnRenamed("__n", "pick").drop("__g", "__over")


def round_robin(df: DataFrame, by: list[str], group: str, liquidity: str, tie: str, per_group: int, most: int) -> DataFrame:
    """Up to per_group rows of each group by liquidity, taken round-robin (all firsts by their group's liquidity, then all seconds), at most `most`."""
    first = df.withColumn("__r", F.row_number().over(W.partitionBy(*by, group).orderBy(F.col(liquidity).desc(), tie))).withColumn("__l", F.max(liquidity).over(W.partitionBy(*by, group)))
    turn = W.partitionBy(*by).orderBy("__r", F.col("__l").desc(), group, tie)
    return first.filter(F.col("__r") <= per_group).withColumn("pick", F.row_number().over(turn)).filter(F.col("pick") <= most).drop("__r", "__l")


def process_factors(df: DataFrame, by: list[str], code: str, label: str, factors: dict[str, tuple[float, int]], low: float = 0.01, high: float = 0.99, min_coverage: float = 0.5, not_demeaned: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Factor pipeline: winsorize, z-score, demean by label, sign; weights renormalised over what a row has.

    factors: name -> (weight, +1 or -1). Returns (scores, long table): score = sum of contributions,
    coverage = available / total weight, low_coverage flag, top: five largest contributions as text. Factors in not_demeaned (one value a label, as
    a sector's sentiment) keep their z-score.
    """
    total = sum(w for w, _ in factors.values())
    long = df.select(*by, code, label, *[F.col(f).cast("double").alias(f) for f in factors]).unpivot([*by, code, label], list(factors), "factor", "raw")
    weight = reduce(lambda a, b: a.when(F.col("factor") == b[0], b[1][0]), list(factors.items()), F.when(F.lit(False), 0.0))
    sign = reduce(lambda a, b: a.when(F.col("factor") == b[0], b[1][1]), list(factors.items()), F.when(F.lit(False), 0))
    group = [*by, "factor"]
    long = winsorize(long.withColumn("weight", weight).withColumn("sign", sign), "raw", group, low, high, "clipped")
    long = long.withColumn("z", zscore("clipped", group))
    neutral = neutralize("z", group, label)
    if not_demeaned:
        neutral = F.when(F.col("factor").isin(*not_demeaned), F.col("z")).otherwise(neutral)
    long = long.withColumn("neutral", neutral * F.col("sign"))
    there = F.when(F.col("neutral").isNotNull(), F.col("weight"))
    part = F.col("neutral") * F.col("weight")
    held = F.collect_list(F.when(part.isNotNull(), F.struct((-F.abs(part)).alias("a"), F.col("factor"))))
    # a row's contributions meet in one grouping; the five largest are the first of its few factors by size
    scores = long.groupBy(*by, code, label).agg(F.coalesce(F.sum(there), F.lit(0.0)).alias("__have"), F.sum(part).alias("__sum"), held.alias("__parts"))
    scores = scores.select(
        *by,
        code,
        label,
        F.coalesce(F.when(F.col("__have") > 0, F.col("__sum") / F.col("__have")), F.lit(0.0)).alias("score"),
        (F.col("__have") / total).alias("coverage"),
        F.array_join(F.transform(F.slice(F.sort_array("__parts"), 1, 5), lambda x: x["factor"]), ";").alias("top"),
    ).withColumn("low_coverage", F.col("coverage") < min_coverage)
    available = F.coalesce(F.sum(there).over(W.partitionBy(*by, code)), F.lit(0.0))
    long = long.withColumn("available", available).withColumn("contribution", F.when(F.col("available") > 0, part / F.col("available")))
    long = long.withColumn("place", F.row_number().over(W.partitionBy(*by, code).orderBy(F.abs("contribution").desc_nulls_last(), "factor")))
    return scores, long
