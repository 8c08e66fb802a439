"""Information coefficients, calibration, drift, splits and research statistics."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.scalar import col, corr, safe_ratio
from panelforge.operators.xsec import pct_rank
from panelforge.sources.store import held


def daily_ic(df: DataFrame, by: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Spearman correlation per group over rows valid on both sides: at least `least` of them and two distinct values of each."""
    v = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__x", pct_rank(x, by)).withColumn("__y", pct_rank(y, by))
    g = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), corr("__x", "__y").alias("ic"), F.min("__x").alias("__a"), F.max("__x").alias("__b"), F.min("__y").alias("__c"), F.max("__y").alias("__d"))
    return g.filter((F.col("n") >= least) & (F.col("__a") < F.col("__b")) & (F.col("__c") < F.col("__d"))).select(*by, "n", "ic")


def ic_summary(ic: DataFrame, by: list[str], date: str) -> DataFrame:
    """Mean, deviation, ratio, t statistic, share of positive days and lag-1 autocorrelation of daily coefficients."""
    w = W.partitionBy(*by).orderBy(date)
    d = ic.withColumn("__l", F.lag("ic").over(w))
    both = F.when(F.col("__l").isNotNull(), F.col("ic"))
    g = d.groupBy(*by).agg(F.count("ic").alias("days"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.avg((F.col("ic") > 0).cast("int")).alias("positive"), corr(both, "__l").alias("autocorr"))
    return g.withColumn("icir", safe_ratio("mean_ic", "std_ic")).withColumn("t", F.col("icir") * F.sqrt("days"))


def half_life(autocorr: str | Column, low: float = 1.0, high: float = 60.0) -> Column:
    """Days after which a signal with this daily autocorrelation is worth half, between low and high."""
    a = col(autocorr)
    raw = math.log(0.5) / F.log(a)
    return F.when(a.isNull() | (a <= 0), low).when(a >= 1, high).otherwise(F.least(F.greatest(raw, F.lit(low)), F.lit(high)))


def long_short(df: DataFrame, by: list[str], score: str, ret: str, tie: str, share: float = 0.2) -> DataFrame:
    """Mean return of the top floor(share x n) rows minus that of the bottom ones."""
    n = F.floor(F.count(F.lit(1)).over(W.partitionBy(*by)) * share)
    d = df.withColumn("__n", n).withColumn("__top", F.row_number().over(W.partitionBy(*by).orderBy(F.col(score).desc(), tie))).withColumn("__low", F.row_number().over(W.partitionBy(*by).orderBy(F.col(score), F.col(tie).desc())))
    return d.groupBy(*by).agg((F.avg(F.when(F.col("__top") <= F.col("__n"), F.col(ret))) - F.avg(F.when(F.col("__low") <= F.col("__n"), F.col(ret)))).alias("spread"))


def coverage(df: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """Coverage, missing, mean, 5/50/95 percent quantiles and deviation of each feature."""
    long = df.select(*by, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(by, features, "feature", "value")
    g = long.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("present"), F.avg("value").alias("mean"), F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("__q"), F.stddev_samp("value").alias("std"))
    return g.select(*by, "feature", "rows", (F.col("rows") - F.col("present")).alias("missing"), (F.col("present") / F.col("rows")).alias("coverage"), "mean", F.col("__q")[0].alias("p5"), F.col("__q")[1].alias("p50"), F.col("__q")[2].alias("p95"), "std")


def prediction_accuracy(df: DataFrame, probs: dict[str, str], label: str, by: list[str]) -> DataFrame:
    """Argmax hit rate and multi-class Brier score. probs: class -> column; ties go to the first class given."""
    best = F.greatest(*[F.col(c) for c in probs.values()])
    guess = F.coalesce(*[F.when(F.col(c) == best, F.lit(k)) for k, c in probs.items()])
    brier = sum(((F.col(c) - (F.col(label) == k).cast("int")) ** 2 for k, c in probs.items()), F.lit(0.0))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((guess == F.col(label)).cast("int")).alias("hit_rate"), F.avg(brier).alias("brier"))


def reliability(df: DataFrame, by: list[str], prob: str, outcome: str, bins: int = 10) -> DataFrame:
    """Per bin of predicted probability: rows, mean prediction, observed rate."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return df.withColumn("bin", b).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("predicted"), F.avg(F.col(outcome).cast("double")).alias("observed"))


def calibration_error(curve: DataFrame, by: list[str]) -> DataFrame:
    return curve.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))) / F.sum("n")).alias("ece"))


def calibration_slope(df: DataFrame, prob: str, outcome: str, rounds: int = 50) -> float:
    """Slope of a logistic fit of the outcome on the logit: Newton steps whose sums Spark aggregates; the driver sees five numbers a step."""
    p = F.least(F.greatest(F.col(prob), F.lit(1e-6)), F.lit(1 - 1e-6))
    d = df.select(F.log(p / (1 - p)).alias("x"), F.col(outcome).cast("double").alias("y")).cache()
    a, b = 0.0, 1.0
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w = q * (1 - q)
        g0, g1, h00, h01, h11 = d.agg(F.sum(F.col("y") - q), F.sum((F.col("y") - q) * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") ** 2)).first()
        det = (h00 or 0) * (h11 or 0) - (h01 or 0) ** 2
        if not det > 1e-12:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    d.unpersist()
    return b


def psi(actual: DataFrame, expected: DataFrame, by: list[str], x: str, edges: list[float], eps: float = 1e-6) -> DataFrame:
    """Population stability index over the bins that the interior edges cut."""
    b = sum(((F.col(x) > e).cast("int") for e in edges), F.lit(0))
    shares = []
    for name, d in (("a", actual), ("e", expected)):
        g = d.filter(F.col(x).isNotNull()).withColumn("bin", b).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("__n"))
        shares.append(g.select(*by, "bin", (F.col("__n") / F.sum("__n").over(W.partitionBy(*by))).alias(name)))
    j = shares[0].join(shares[1], [*by, "bin"], "full_outer")
    a, e = F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(eps)), F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(eps))
    return j.groupBy(*by).agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def out_of_range(df: DataFrame, by: list[str], x: str, low: float, high: float) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((~F.col(x).between(low, high)).cast("int")).alias("ood_ratio"))


def feature_drift(actual: DataFrame, expected: DataFrame, by: list[str], x: str, bins: int, eps: float = 1e-6) -> DataFrame:
    """Per key the stability index of a feature over bins cut at quantiles of the expected rows, and the share of actual rows outside their 1 to 99 %."""
    cuts = [i / bins for i in range(1, bins)]
    q = expected.groupBy(*by).agg(F.percentile(x, F.array(*map(F.lit, cuts))).alias("__e"), F.percentile(x, F.array(F.lit(0.01), F.lit(0.99))).alias("__r"))
    both = actual.select(*by, x, F.lit(1).alias("__a")).unionByName(expected.select(*by, x, F.lit(0).alias("__a"))).filter(F.col(x).isNotNull()).join(q, by)
    both = both.withColumn("bin", F.size(F.filter("__e", lambda e: F.col(x) > e))).withColumn("__o", (F.col(x) < F.col("__r")[0]) | (F.col(x) > F.col("__r")[1]))
    n = both.groupBy(*by, "bin").agg(F.sum("__a").alias("a"), F.sum(1 - F.col("__a")).alias("e"), F.sum(F.col("__a") * F.col("__o").cast("int")).alias("o"))
    w = W.partitionBy(*by)
    s = n.withColumn("__n", F.sum("a").over(w)).withColumn("__pa", F.greatest(F.col("a") / F.sum("a").over(w), F.lit(eps))).withColumn("__pe", F.greatest(F.col("e") / F.sum("e").over(w), F.lit(eps)))
    return s.filter("__n > 0").groupBy(*by).agg((F.sum("o") / F.sum("a")).alias("ood_ratio"), F.sum((F.col("__pa") - F.col("__pe")) * F.log(F.col("__pa") / F.col("__pe"))).alias("psi"))


def walk_forward(df: DataFrame, date: str, label_end: str, folds: int, embargo: int) -> DataFrame:
    """(fold, role) rows: validation blocks of equal dates; training rows lie `embargo` dates before the block and their label ended before it begins.

    Dates are numbered in a table of dates only.
    """
    dates = df.select(date).distinct().withColumn("__i", F.row_number().over(W.orderBy(date)) - 1)
    n = dates.count()
    size = max(1, n // (folds + 1))
    starts = {r["__i"]: r[date] for r in dates.filter(F.col("__i").isin([size * (k + 1) for k in range(folds)])).collect()}
    numbered = df.join(F.broadcast(dates), date)  # a row a date
    parts = []
    for k in range(folds):
        first = size * (k + 1)
        last = n if k == folds - 1 else first + size
        if first not in starts:
            continue
        role = F.when(F.col("__i").between(first, last - 1), "validation").when((F.col("__i") < first - embargo) & (F.col(label_end) < starts[first]), "train")
        parts.append(F.struct(F.lit(k).alias("fold"), role.alias("role")))
    return numbered.withColumn("__f", F.explode(F.array(*parts))).filter("__f.role is not null").select(*df.columns, "__f.fold", "__f.role")


def extraction_quality(reference: DataFrame, predicted: DataFrame, document: str, kind: str) -> DataFrame:
    """True and false positives and misses at (document, kind), with precision and recall, per kind."""
    a, b = reference.select(document, kind).distinct().withColumn("__r", F.lit(1)), predicted.select(document, kind).distinct().withColumn("__p", F.lit(1))
    j = a.join(b, [document, kind], "full_outer")
    count = lambda c: F.sum(c.cast("int"))
    g = j.groupBy(kind).agg(count(F.col("__r").isNotNull() & F.col("__p").isNotNull()).alias("tp"), count(F.col("__r").isNull()).alias("fp"), count(F.col("__p").isNull()).alias("fn"))
    return g.withColumn("precision", safe_ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", safe_ratio("tp", F.col("tp") + F.col("fn")))


def benjamini_hochberg(p: dict[str, float], rate: float = 0.1) -> set[str]:
    """Names whose p-value passes the false discovery rate."""
    order = sorted(p, key=lambda k: (p[k], k))
    passed = [i for i, k in enumerate(order, 1) if p[k] <= rate * i / len(order)]
    return set(order[: max(passed)]) if passed else set()


def greedy_selection(stats: dict[str, float], correlation: dict[tuple[str, str], float], family: dict[str, str], most: int, limit: float, family_cap: int) -> list[str]:
    """Features by falling strength, without those correlated with a chosen one over the limit and beyond the family's cap."""
    chosen: list[str] = []
    for f in sorted(stats, key=lambda k: (-stats[k], k)):
        near = any(abs(correlation.get((f, g), correlation.get((g, f), 0.0))) > limit for g in chosen)
        if len(chosen) < most and not near and sum(family.get(g) == family.get(f) for g in chosen) < family_cap:
            chosen.append(f)
    return chosen


def stationary_bootstrap(values: np.ndarray, block: float, samples: int, seed: int, threshold: float = 0.0) -> float:
    """Share of stationary block bootstrap means over the threshold."""
    rng = np.random.default_rng(seed)
    n, hits = len(values), 0
    for _ in range(samples):
        at = rng.integers(n)
        picks = np.empty(n, int)
        for i in range(n):
            picks[i] = at
            at = rng.integers(n) if rng.random() < 1 / block else (at + 1) % n
        hits += values[picks].mean() > threshold
    return hits / samples


def deflated_sharpe(observed: float, trials: list[float], observations: int, skew: float, kurtosis: float, year: int = 252) -> float:
    """Probability that the Sharpe ratio exceeds the expected best of that many trials of no skill."""
    return _deflated(observed, float(np.std(trials, ddof=1)) if len(trials) > 1 else 0.0, len(trials), observations, skew, kurtosis, year)


def _deflated(observed: float, deviation: float, trials: int, observations: int, skew: float, kurtosis: float, year: int = 252) -> float:
    from statistics import NormalDist

    z, sd, n = NormalDist(), deviation / math.sqrt(year), max(2, trials)
    best = sd * ((1 - np.euler_gamma) * z.inv_cdf(1 - 1 / n) + np.euler_gamma * z.inv_cdf(1 - 1 / (n * math.e)))
    s = observed / math.sqrt(year)
    return z.cdf((s - best) * math.sqrt(observations - 1) / math.sqrt(max(1e-12, 1 - skew * s + (kurtosis - 1) / 4 * s * s)))


def overfit_probability(blocks: np.ndarray) -> float:
    """Combinatorially symmetric cross-validation over block sums (trials x blocks x (n, sum, sum of squares)): share of splits whose
    in-sample best ranks below the median out of sample."""
    trials, n, _ = blocks.shape

    def sharpe(idx):
        k, s, q = blocks[:, list(idx)].sum(axis=1).T
        mean = s / k
        return mean / np.sqrt(np.maximum(q / k - mean**2, 1e-18))

    below, total = 0, 0
    for inside in itertools.combinations(range(n), n // 2):
        outside = [i for i in range(n) if i not in inside]
        best = int(np.argmax(sharpe(inside)))
        rank = (sharpe(outside) < sharpe(outside)[best]).sum() / max(1, trials - 1)
        below += rank < 0.5
        total += 1
    return below / total


def overfitting(sums: DataFrame, trial: str, year: int = 252, blocks: int = 8) -> tuple[str, float, float, float] | None:
    """(best trial, its Sharpe ratio, deflated, probability of overfitting as overfit_probability has it) from rows (trial, block, n, s, q); ties go to the first trial. None without rows.

    A trial's blocks are one row; batches of them send their best trial and moments for each split, and in a second pass how many lie below the best, so the driver's memory does
    not grow with the trials.
    """
    splits = [(i, [k for k in range(blocks) if k not in i]) for i in itertools.combinations(range(blocks), blocks // 2)]
    rows = held(sums.groupBy(F.col(trial).alias("t")).agg(F.collect_list(F.struct("block", "n", "s", "q")).alias("b")), "trials")

    def tables(batches):
        for pdf in batches:
            x = np.full((len(pdf), blocks, 3), 1e-12)
            for i, row in enumerate(pdf["b"]):
                for b in row:
                    x[i, b["block"]] = b["n"], b["s"], b["q"]
            yield pdf["t"].to_numpy(), x

    def sharpe(x, idx):
        k, s, q = x[:, list(idx)].sum(axis=1).T
        mean = s / k
        return mean / np.sqrt(np.maximum(q / k - mean**2, 1e-18))

    def first(batches):
        for names, x in tables(batches):
            out = []
            n, s, q = x.sum(axis=1).T
            whole = s / n / np.sqrt(np.maximum(q / n - (s / n) ** 2, 1e-18)) * year**0.5
            for k, (inside, outside) in enumerate([(None, None), *splits]):
                value = whole if inside is None else sharpe(x, inside)
                at = min(np.flatnonzero(value == value.max()), key=lambda i: names[i])
                out.append((k, len(names), names[at], value[at], n[at] if inside is None else sharpe(x, outside)[at], whole.mean(), ((whole - whole.mean()) ** 2).sum()))
            yield pd.DataFrame(out, columns=["k", "n", "t", "v", "o", "m", "m2"])

    kind = rows.schema["t"].dataType.simpleString()
    # the greatest value, of equal ones the first trial; moments of batches add up to those of all
    best: dict[int, tuple] = {}
    count, mean, square = 0, 0.0, 0.0
    for r in rows.mapInPandas(first, f"k int, n long, t {kind}, v double, o double, m double, m2 double").toLocalIterator():
        k = r["k"]
        if k not in best or r["v"] > best[k][0] or (r["v"] == best[k][0] and r["t"] < best[k][1]):
            best[k] = (r["v"], r["t"], r["o"])
        if k == 0:
            gap, total = r["m"] - mean, count + r["n"]
            mean, square, count = mean + gap * r["n"] / total, square + r["m2"] + gap * gap * count * r["n"] / total, total
    if not best:
        return None

    def second(batches):
        for _, x in tables(batches):
            yield pd.DataFrame({"k": range(1, len(splits) + 1), "below": [int((sharpe(x, outside) < best[k][2]).sum()) for k, (_, outside) in enumerate(splits, 1)]})

    below = rows.mapInPandas(second, "k int, below long").groupBy("k").agg(F.sum("below").alias("below")).collect()
    probability = sum(r["below"] / max(1, count - 1) < 0.5 for r in below) / len(splits)
    value, name, n = best[0]
    deviation = math.sqrt(square / (count - 1)) if count > 1 else 0.0
    return name, float(value), float(_deflated(float(value), deviation, count, int(n), 0.0, 3.0, year)), float(probability)


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic fit by pooling adjacent violators."""
    level: list[list[float]] = []
    for v, w in zip(values, weights):
        level.append([v, w, 1])
        while len(level) > 1 and level[-2][0] > level[-1][0]:
            b, a = level.pop(), level.pop()
            level.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([[v] * int(n) for v, _, n in level]) if level else np.zeros(0)
