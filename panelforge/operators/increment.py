"""Does a second family of features (events) add to a first one? Paired walk-forward evaluation on the same rows and folds.

Both models are ridge fits whose normal equations come from one aggregate per fold over the wider feature list; the
narrow model takes its rows and columns of the same sums. What is compared is a number a validation date: rank
correlations, and the excess of the best fifth every `horizon` dates. Intervals come from a moving-block bootstrap whose
blocks are the same for both models, drawn by hashes, so samples are rows of a distributed table and a rerun draws
the same blocks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.operators import evaluation
from panelforge.operators.learning import gate
from panelforge.sources.store import held

#: Fixed values of the admission gate: least active dates and rows, least periods, most added turnover a year.
LEAST_DATES, LEAST_ROWS, LEAST_PERIODS, MOST_TURNOVER = 20, 100, 3, 0.5
TINY = 1e-12


def support(rows: DataFrame, events: list[str], date: str = "trade_date", coverage: str | None = None, least_dates: int = LEAST_DATES, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row: rows, dates, covered and active rows with their shares, active dates, status (supported or insufficient_support).

    A row is active where an event feature is not 0 and the row is covered; without a coverage column active rows are the covered ones.
    Missing features count as 0.
    """
    active = reduce(lambda a, b: a | b, [F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) > TINY for c in events], F.lit(False))
    covered = F.coalesce(F.col(coverage).cast("double"), F.lit(0.0)) > 0 if coverage else active
    d = rows.select(date, covered.alias("__c"), (active & covered).alias("__a"))
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    g = d.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(date).alias("dates"), count("__c").alias("covered_rows"), count("__a").alias("active_rows"), F.countDistinct(F.when(F.col("__a"), F.col(date))).alias("active_dates"))
    share = lambda c: F.when(F.col("rows") > 0, F.col(c) / F.col("rows")).otherwise(0.0)
    enough = (F.col("active_dates") >= least_dates) & (F.col("active_rows") >= least_rows)
    return g.withColumns({"covered_ratio": share("covered_rows"), "active_ratio": share("active_rows"), "status": F.when(enough, "supported").otherwise("insufficient_support")})


def fold_coefficients(split: DataFrame, features: list[str], target: str, penalty: float, narrow: list[str] | None = None, sums: list | None = None) -> dict[int, np.ndarray]:
    """fold -> intercept and coefficients of a ridge fit on its training rows; those outside `narrow` are 0. One aggregate (or the fold_sums given), a few sums a fold reach the driver."""
    names = ["__one", *features]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = fold_sums(split, features, target) if sums is None else sums
    live = [i for i, n in enumerate(names) if narrow is None or n == "__one" or n in narrow]
    out = {}
    for row in sums:
        a, b = np.zeros((len(names), len(names))), np.array([x or 0.0 for x in row[1 + len(pairs) :]])
        for (i, j), v in zip(pairs, row[1:]):
            a[i, j] = a[j, i] = v or 0.0
        a[range(1, len(names)), range(1, len(names))] += penalty
        out[row["fold"]] = np.zeros(len(names))
        out[row["fold"]][live] = np.linalg.lstsq(a[np.ix_(live, live)], b[live], rcond=None)[0]
    return out


def fold_sums(split: DataFrame, features: list[str], target: str) -> list:
    """A row a fold: sums of products of its training rows' features, and with the target."""
    names = ["__one", *features]
    d = split.filter((F.col("role") == "train") & F.col(target).isNotNull()).withColumn("__one", F.lit(1.0)).fillna(0.0, features)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    return d.groupBy("fold").agg(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs], *[F.sum(F.col(n) * F.col(target)) for n in names]).collect()


def linear(weights: dict[int, np.ndarray], features: list[str]) -> Column:
    """Score of a row by the coefficients of its fold; null in a fold without training rows."""
    score = F.lit(None).cast("double")
    for fold, w in weights.items():
        of = reduce(lambda x, y: x + y, [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) * float(b) for n, b in zip(features, w[1:])], F.lit(float(w[0])))
        score = F.when(F.col("fold") == fold, of).otherwise(score)
    return score


def paired_scores(rows: DataFrame, base: list[str], events: list[str], target: str, date: str, label_end: str, folds: int, embargo: int, penalty: float) -> DataFrame:
    """Validation rows with `base` and `candidate` scores, and the candidate's coefficient of each event feature as `w_<feature>`."""
    features = [*base, *[e for e in events if e not in base]]
    split = evaluation.walk_forward(rows, date, label_end, folds, embargo)
    sums = fold_sums(split, features, target)
    wide, narrow = fold_coefficients(split, features, target, penalty, None, sums), fold_coefficients(split, features, target, penalty, base, sums)
    valid = split.filter((F.col("role") == "validation") & F.col(target).isNotNull()).withColumns({"base": linear(narrow, features), "candidate": linear(wide, features)})
    for e in events:
        w = F.lit(None).cast("double")
        for fold, b in wide.items():
            w = F.when(F.col("fold") == fold, float(b[1 + features.index(e)])).otherwise(w)
        valid = valid.withColumn(f"w_{e}", w)
    return valid.filter("base is not null and candidate is not null")


def period_returns(scores: DataFrame, score: str, target: str, date: str, code: str, horizon: int, share: float = 0.2, cost: float = 0.0015) -> DataFrame:
    """(date, period, gross, turnover, net) of every `horizon`-th date: the mean target of the best `share` of rows (at least one, ties by code) over that of all, less `cost` a unit of turnover against the period before.

    Dates are numbered in a table of dates only.
    """
    dates = scores.select(date).distinct().withColumn("__i", F.row_number().over(W.orderBy(date)) - 1).filter(F.col("__i") % horizon == 0).select(date, (F.col("__i") / horizon).cast("int").alias("period"))
    w = W.partitionBy(date)
    d = scores.select(date, code, score, target).join(F.broadcast(dates), date)  # a row a period
    d = d.withColumn("__place", F.row_number().over(w.orderBy(F.col(score).desc(), code))).withColumn("__n", F.count(F.lit(1)).over(w))
    d = d.withColumn("__in", F.col("__place") <= F.greatest(F.floor(F.col("__n") * share), F.lit(1)))
    gross = d.groupBy("period", date).agg((F.avg(F.when(F.col("__in"), F.col(target))) - F.avg(target)).alias("gross"), F.sum(F.col("__in").cast("long")).alias("__k"))
    held = d.filter("__in").select("period", code)
    stay = held.join(held.select((F.col("period") + 1).alias("period"), code), ["period", code]).groupBy("period").agg(F.count(F.lit(1)).alias("__s"))
    out = gross.join(stay, "period", "left").withColumn("turnover", 1 - F.coalesce("__s", F.lit(0)) / F.col("__k"))
    return out.select(date, "period", "gross", "turnover", (F.col("gross") - F.col("turnover") * cost).alias("net"))


def uniform(seed: int, *parts: str | Column) -> Column:
    """A whole number below 2^32 drawn from the MD5 of seed and parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def paired_bootstrap(pairs: DataFrame, order: str, base: str, candidate: str, samples: int, block: int, seed: int) -> DataFrame:
    """One row: periods, mean difference, its 2.5 and 97.5 % quantiles over samples of moving blocks, and the share of samples over 0.

    pairs: a row a period (a table of dates). A sample is ceil(n / block) blocks of consecutive differences, the same periods for both sides. Without
    rows the result is one row of periods 0 and nulls.
    """
    d = pairs.select(order, (F.col(candidate) - F.col(base)).alias("__d")).filter("__d is not null")
    n = d.count()
    if not n:
        return pairs.sparkSession.range(1).select(F.lit(0).cast("long").alias("periods"), *[F.lit(None).cast("double").alias(c) for c in ("mean_delta", "low", "high", "positive")])
    size = max(1, min(block, n))
    by = W.orderBy(order)
    blocks = d.select((F.row_number().over(by) - 1).cast("long").alias("start"), F.sum("__d").over(by.rowsBetween(0, size - 1)).alias("__s"))
    draws = pairs.sparkSession.range(samples).withColumnRenamed("id", "sample").select("sample", F.explode(F.sequence(F.lit(0), F.lit(-(-n // size) - 1))).alias("draw"))
    draws = draws.withColumn("start", uniform(seed, "sample", "draw") % (n - size + 1))
    means = draws.join(blocks, "start").groupBy("sample").agg((F.sum("__s") / (size * -(-n // size))).alias("__m"))
    q = means.agg(F.percentile("__m", F.array(F.lit(0.025), F.lit(0.975))).alias("__q"), F.avg((F.col("__m") > 0).cast("double")).alias("positive"))
    mean = d.agg(F.count(F.lit(1)).alias("periods"), F.avg("__d").alias("mean_delta"))
    return mean.crossJoin(q).select("periods", "mean_delta", F.col("__q")[0].alias("low"), F.col("__q")[1].alias("high"), "positive")  # a row each


def permutation_importance(scores: DataFrame, events: list[str], target: str, date: str, code: str, seed: int) -> DataFrame:
    """(feature, importance): mean daily rank correlation of the candidate score less that with the feature's values dealt anew among the rows of their date.

    Rows of a date swap values by the order of hashes; scores are linear, so a dealt value changes them by its coefficient times the difference. A date's rows
    are one group and move once; a number a feature leaves it.
    """
    columns = {f"__{k}_{i}": c for i, e in enumerate(events) for k, c in (("x", F.coalesce(F.col(e).cast("double"), F.lit(0.0))), ("w", F.col(f"w_{e}")), ("h", uniform(seed, F.lit(e), code, date)))}
    d = scores.select(F.col(date).alias("__date"), F.col(code).alias("__code"), F.col(target).cast("double").alias("__y"), "candidate", *[c.alias(n) for n, c in columns.items()])

    def spearman(x: pd.Series, y: pd.Series) -> float | None:
        ok = x.notna() & y.notna()
        a, b = x[ok].rank(), y[ok].rank()
        return float(np.corrcoef(a, b)[0, 1]) if len(a) >= 3 and a.min() < a.max() and b.min() < b.max() else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, at = [], np.argsort(pdf["__code"].to_numpy(), kind="stable")
        before = spearman(pdf["candidate"], pdf["__y"])
        for i, e in enumerate(events):
            x = pdf[f"__x_{i}"].to_numpy()
            dealt = np.empty(len(x))
            dealt[at] = x[at[np.argsort(pdf[f"__h_{i}"].to_numpy()[at], kind="stable")]]
            out.append((e, before, spearman(pdf["candidate"] + pdf[f"__w_{i}"] * (dealt - x), pdf["__y"])))
        return pd.DataFrame(out, columns=["feature", "a", "b"])

    daily = d.groupBy("__date").applyInPandas(run, "feature string, a double, b double").filter("a is not null and b is not null and not isnan(a) and not isnan(b)")
    return daily.groupBy("feature").agg((F.avg("a") - F.avg("b")).alias("importance"))


def _metrics(scores: DataFrame, score: str, periods: DataFrame, target: str, date: str, horizon: int, year: int) -> DataFrame:
    """One row of a score's mean rank correlation and of its portfolio's yearly net excess, Sharpe ratio, drawdown and turnover."""
    ic = evaluation.daily_ic(scores, [date], score, target).agg(F.avg("ic").alias("rank_ic"))
    many = year / horizon
    by = W.orderBy("period")  # a table of dates
    wealth = periods.withColumn("__v", F.exp(F.sum(F.log1p(F.greatest("net", F.lit(-0.999999)))).over(by)))
    wealth = wealth.withColumn("__d", 1 - F.col("__v") / F.greatest(F.max("__v").over(by.rowsBetween(W.unboundedPreceding, 0)), F.lit(1.0)))
    own = wealth.agg((F.avg("net") * many).alias("net_excess_return"), (F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * float(many**0.5)).alias("portfolio_sharpe"), F.max("__d").alias("max_drawdown"), (F.avg("turnover") * many).alias("annual_turnover"))
    return ic.crossJoin(own)  # a row each


DELTAS = ["rank_ic", "net_excess_return", "portfolio_sharpe", "max_drawdown", "annual_turnover"]


def increment(rows: DataFrame, base: list[str], events: list[str], target: str, label_end: str, horizon: int, date: str = "trade_date", code: str = "code", coverage: str | None = None, folds: int = 3, penalty: float = 1.0, samples: int = 2000, block: int = 5, seed: int = 1729, year: int = 252, least_dates: int = LEAST_DATES, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row: support, status (insufficient_support or complete), differences candidate - base, the paired interval, the most important event feature, admission with its reasons.

    Features are centered and scaled by the caller; missing ones count as 0. Without support nothing is fitted and all
    differences are null. Admission needs a better rank correlation and net excess, no deeper drawdown, bounded added
    turnover, LEAST_PERIODS periods, an interval above 0 and an event feature of positive permutation importance.
    """
    features = [*base, *[e for e in events if e not in base]]
    rows = held(rows.select(*dict.fromkeys([date, code, target, label_end, *features, *([coverage] if coverage else [])])), "increment")
    s = support(rows, events, date, coverage, least_dates, least_rows)
    empty = {**{f"delta_{c}": F.lit(None).cast("double") for c in DELTAS}, **{c: F.lit(None).cast("double") for c in ("mean_delta", "low", "high", "positive")}, "periods": F.lit(0).cast("long"), "top_feature": F.lit(None).cast("string"), "importance": F.lit(None).cast("double")}
    if s.first()["status"] != "supported":
        return _admitted(s.withColumns(empty))
    scores = paired_scores(rows, base, events, target, date, label_end, folds, horizon, penalty)
    scores = held(scores.select(date, code, target, "base", "candidate", *dict.fromkeys([*events, *[f"w_{e}" for e in events]])), "scores")
    kept = {k: period_returns(scores, k, target, date, code, horizon) for k in ("base", "candidate")}
    both = kept["base"].select("period", F.col("net").alias("base")).join(kept["candidate"].select("period", F.col("net").alias("candidate")), "period")
    metrics = {k: _metrics(scores, k, kept[k], target, date, horizon, year) for k in kept}
    a, b = (metrics[k].select(*[F.col(c).alias(f"{k}_{c}") for c in DELTAS]) for k in ("base", "candidate"))
    best = permutation_importance(scores, events, target, date, code, seed).agg(F.max_by("feature", "importance").alias("top_feature"), F.max("importance").alias("importance"))
    out = s.crossJoin(a).crossJoin(b).crossJoin(paired_bootstrap(both, "period", "base", "candidate", samples, block, seed)).crossJoin(best)  # a row each
    out = out.withColumns({f"delta_{c}": F.col(f"candidate_{c}") - F.col(f"base_{c}") for c in DELTAS}).withColumn("status", F.lit("complete"))
    return _admitted(out.drop(*[f"{k}_{c}" for k in kept for c in DELTAS]))


def _admitted(report: DataFrame) -> DataFrame:
    rules = [
        ("support", F.col("status") == "complete"),
        ("rank_ic_uplift", F.col("delta_rank_ic") > 0),
        ("net_excess_return_uplift", F.col("delta_net_excess_return") > 0),
        ("drawdown_not_worse", F.col("delta_max_drawdown") <= 0),
        ("turnover_uplift_bounded", F.col("delta_annual_turnover") <= MOST_TURNOVER),
        ("paired_period_support", F.col("periods") >= LEAST_PERIODS),
        ("paired_return_ci_positive", F.col("low") > 0),
        ("positive_permutation_importance", F.col("importance") > 0),
    ]
    return gate(report, rules)
