"""Preparing, fitting, calibrating and watching models: statistics are Spark aggregates, what remains small is fitted on the driver."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.scalar import col, corr, truth
from panelforge.operators import evaluation
from panelforge.operators.xsec import pct_rank
from panelforge.sources.store import held


def column_quantiles(df: DataFrame, columns: dict[str, Column], cuts: list[float], accuracy: int = 5_000) -> dict[str, list[float]]:
    """name -> quantiles of a column's values that are not null, between neighbours in proportion as F.percentile gives them; none for a column without values.

    Two passes and no list of all values: sketches give ranges that hold the wanted places, what lies outside is only counted, and the distinct values
    inside are counted and put in order. A place that a sketch missed is searched again in wider ranges.
    """
    d = df.select(*[x.cast("double").alias(c) for c, x in columns.items()])
    rising = lambda v: (math.isnan(v), v)
    near, todo, out = 3 / accuracy, dict.fromkeys(columns), {c: [] for c in columns}
    while todo:
        asked = sorted({min(max(p + side * near, 0.0), 1.0) for p in cuts for side in (-1, 1)})
        row = d.agg(*[f(c).alias(f"{c}__{k}") for c in todo for k, f in (("n", F.count), ("a", F.min), ("b", F.max), ("q", lambda c: F.percentile_approx(c, asked, accuracy)))]).first()
        todo = {c: int(row[f"{c}__n"]) for c in todo if row[f"{c}__n"]}
        places, place, wanted = {}, F.lit(None).cast("int"), F.lit(False)
        for c, n in todo.items():
            at = lambda p: row[f"{c}__a"] if p <= 0 else row[f"{c}__b"] if p >= 1 else row[f"{c}__q"][asked.index(p)]  # noqa: B023, E731
            ranges: list[list[float]] = []
            for p in sorted(cuts):
                low, high = (at(min(max(p + side * near, 0.0), 1.0)) for side in (-1, 1))
                if ranges and rising(low) <= rising(ranges[-1][1]):
                    ranges[-1][1] = max(ranges[-1][1], high, key=rising)
                else:
                    ranges.append([low, high])
            where = F.lit(2 * len(ranges))
            for i, (low, high) in reversed(list(enumerate(ranges))):
                where = F.when(F.col("x") < low, 2 * i).when(F.col("x") <= high, 2 * i + 1).otherwise(where)
            place = F.when(F.col("c") == c, where).otherwise(place)
            places[c] = sorted({k for p in cuts for k in (math.floor((n - 1) * p), math.ceil((n - 1) * p))})
            hit = F.lit(False)
            for k in places[c]:
                hit = hit | ((F.col("s") > k) & (F.col("s") - F.col("m") <= k))
            wanted = F.when(F.col("c") == c, hit).otherwise(wanted)
        if not todo:
            break
        long = d.unpivot([], list(todo), "c", "x").filter("x is not null").withColumn("p", place)
        counts = long.groupBy("c", "p", F.when(F.col("p") % 2 == 1, F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("m"))
        found: dict[str, list] = {c: [] for c in todo}
        for r in counts.withColumn("s", F.sum("m").over(W.partitionBy("c").orderBy("p", "x"))).filter(wanted & F.col("x").isNotNull()).collect():
            found[r["c"]].append((r["s"] - r["m"], r["s"], r["x"]))
        for c, n in list(todo.items()):
            value = {k: x for k in places[c] for a, b, x in found[c] if a <= k < b}
            if len(value) == len(places[c]):
                for p in cuts:
                    spot = (n - 1) * p
                    low, high = value[math.floor(spot)], value[math.ceil(spot)]
                    out[c].append(low if low == high else (math.ceil(spot) - spot) * low + (spot - math.floor(spot)) * high)
                del todo[c]
        near = near * 4
    return out


def imputed(df: DataFrame, train: Column, features: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Features as the training rows prescribe: missing values get the median, all are clipped to two quantiles and standardised.

    df is written once and read by every pass; a few statistics a feature reach the driver. A feature that does not vary in training becomes 0.
    """
    d = held(df.withColumns({c: F.col(c).cast("double") for c in features}), "features")
    bounds = {c: q or [0.0, 0.0, 0.0] for c, q in column_quantiles(d.filter(train), {c: F.col(c) for c in features}, [low, 0.5, high]).items()}
    d = d.withColumns({c: F.greatest(F.least(F.coalesce(F.col(c), F.lit(q[1])), F.lit(q[2])), F.lit(q[0])) for c, q in bounds.items()})
    row = d.filter(train).agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    scaled = lambda c: (F.col(c) - row[f"m_{c}"]) / row[f"s_{c}"] if (row[f"s_{c}"] or 0.0) > 0 else F.lit(0.0)
    return d.withColumns({c: scaled(c) for c in features})


def ridge_scores(df: DataFrame, train: Column, features: list[str], target: str, penalty: float, out: str = "score") -> DataFrame:
    """Linear scores by ridge regression (intercept free): the normal equations are one aggregate of the training rows, solved on the driver."""
    ok = train & F.col(target).isNotNull()
    names = ["__one", *features]
    d = df.withColumn("__one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = d.filter(ok).agg(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs], *[F.sum(F.col(n) * F.col(target)) for n in names]).first()
    k = len(names)
    a, b = np.zeros((k, k)), np.array([x or 0.0 for x in sums[len(pairs) :]])
    for (i, j), v in zip(pairs, sums):
        a[i, j] = a[j, i] = v or 0.0
    a[range(1, k), range(1, k)] += penalty
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    return d.withColumn(out, reduce(lambda x, y: x + y, [F.col(n) * float(w) for n, w in zip(names, beta)])).drop("__one")


def classifier_scores(df: DataFrame, train: Column, features: list[str], label: str, penalty: float = 0.01, trees: int = 20, out: str = "probability") -> DataFrame:
    """Mean probability of a logistic regression and of boosted trees, both fitted by pyspark.ml on the training rows; label: 0 or 1."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = VectorAssembler(inputCols=features, outputCol="__x").transform(df)
    own = d.filter(train & F.col(label).isNotNull()).withColumn("__y", F.col(label).cast("double"))
    models = [LogisticRegression(featuresCol="__x", labelCol="__y", regParam=penalty), GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=trees, maxDepth=3, seed=7)]
    for k, m in enumerate(models):
        m.setProbabilityCol(f"__p{k}").setRawPredictionCol(f"__r{k}").setPredictionCol(f"__c{k}")
        d = m.fit(own).transform(d)
    mean = sum((vector_to_array(f"__p{k}")[1] for k in range(len(models))), F.lit(0.0)) / len(models)
    return d.withColumn(out, mean).drop("__x", *[f"__{c}{k}" for k in range(len(models)) for c in "prc"])


def edge_calibration(df: DataFrame, score: str, ret: str, date: str, buckets: int, horizon: int, least_dates: int = 1) -> DataFrame:
    """Expected return of a score's bucket: means of daily means per bucket, their error with dates / horizon as independent days,
    and the monotone fit of pooled neighbours. A row a bucket; that few numbers are pooled on the driver."""
    cut = F.ntile(buckets).over(W.partitionBy(date).orderBy(score, "code"))
    daily = df.filter(F.col(score).isNotNull() & F.col(ret).isNotNull()).withColumn("bucket", cut).groupBy("bucket", date).agg(F.avg(ret).alias("__m"))
    g = daily.groupBy("bucket").agg(F.count(F.lit(1)).alias("dates"), F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("__sd")).filter(F.col("dates") >= least_dates)
    g = g.withColumn("error", F.col("__sd") / F.sqrt(F.greatest(F.col("dates") / max(1, horizon), F.lit(1.0)))).drop("__sd")
    rows = g.orderBy("bucket").collect()
    fit = evaluation.pool_adjacent(np.array([r["mean"] for r in rows]), np.array([float(r["dates"]) for r in rows]))
    return df.sparkSession.createDataFrame([(r["bucket"], r["dates"], r["mean"], r["error"], float(v)) for r, v in zip(rows, fit)], "bucket int, dates long, mean double, error double, fitted double")


def feature_audit(df: DataFrame, features: list[str], target: str, date: str = "trade_date") -> DataFrame:
    """Per feature: coverage, pooled centered-rank correlation with the target, t of its daily rank correlations, and the share of three
    equal windows of dates whose mean daily correlation has the pooled sign. Rows are dealt by date once, whatever the number of features; what
    leaves a date is a row of sums a feature."""
    d = df.select(date, F.col(target).alias("__y"), *features).repartition(date).withColumn("__t", pct_rank("__y", [date]))
    for f in features:
        x, y = F.when(F.col("__y").isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col("__y"))
        d = d.withColumns({f"__r_{f}": pct_rank(f, [date]), f"__x_{f}": pct_rank(x, [date]), f"__y_{f}": pct_rank(y, [date])})
    mean = lambda c: F.avg(c).over(W.partitionBy(date))
    d = d.withColumns({c: F.col(c) - mean(c) for c in ("__t", *[f"__r_{f}" for f in features])})

    def sums(f):
        r, x, y = F.col(f"__r_{f}"), F.col(f"__x_{f}"), F.col(f"__y_{f}")
        vary = (F.count(x) >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        return F.struct(F.lit(f).alias("feature"), F.count(F.lit(1)).alias("rows"), F.count(f).alias("present"), F.sum(r * F.col("__t")).alias("rt"), F.sum(r**2).alias("rr"), F.sum(F.col("__t") ** 2).alias("tt"), F.when(vary, corr(x, y)).alias("ic"))

    daily = d.groupBy(date).agg(F.array(*[sums(f) for f in features]).alias("__f")).withColumn("__w", F.ntile(3).over(W.orderBy(date)))  # a row a date
    daily = held(daily.select(date, "__w", F.inline("__f")), "audit")
    pooled = daily.groupBy("feature").agg(
        (F.sum("present") / F.sum("rows")).alias("coverage"),
        (F.sum("rt") / F.nullif(F.sqrt(F.sum("rr") * F.sum("tt")), F.lit(0.0))).alias("correlation"),
        (F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0)) * F.sqrt(F.count("ic"))).alias("ic_t"),
    )
    windows = daily.groupBy("feature", "__w").agg(F.avg("ic").alias("__ic")).join(pooled, "feature").filter("abs(__ic) > 1e-12")
    signs = windows.groupBy("feature").agg(F.avg((F.signum("__ic") == F.signum("correlation")).cast("double")).alias("stability"))
    return pooled.join(signs, "feature", "left").select("feature", "coverage", "correlation", F.coalesce("stability", F.lit(0.0)).alias("stability"), "ic_t")


def rank_correlations(df: DataFrame, features: list[str], date: str = "trade_date") -> dict[tuple[str, str], float]:
    """Correlation of each pair of features' percentile ranks; one number a pair reaches the driver."""
    d = df.select(*[pct_rank(c, [date]).alias(c) for c in features])
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = d.agg(*[corr(a, b) for a, b in pairs]).first() if pairs else ()
    return {p: v or 0.0 for p, v in zip(pairs, row)}


def select_features(df: DataFrame, features: list[str], target: str, family: dict[str, str], most: int = 20, least_coverage: float = 0.55, limit: float = 0.92, least_ic: float = 0.02, least_stability: float = 0.67, least_t: float = 2.0, family_cap: int = 6) -> DataFrame:
    """(feature, place, score): features by |correlation| x (1 + stability) / 2 among those that cover, hold and differ enough, without near copies of chosen ones and within the family's cap."""
    df = held(df.select("trade_date", target, *features), "features")
    rows = {r["feature"]: r for r in feature_audit(df, features, target).collect()}
    score = {f: abs(r["correlation"] or 0.0) * (0.5 + 0.5 * r["stability"]) for f, r in rows.items() if r["coverage"] >= least_coverage and abs(r["correlation"] or 0.0) >= least_ic and r["stability"] >= least_stability and abs(r["ic_t"] or 0.0) >= least_t}
    chosen = evaluation.greedy_selection(score, rank_correlations(df, sorted(score)), family, most, limit, family_cap) if score else []
    return df.sparkSession.createDataFrame([(f, i, score[f]) for i, f in enumerate(chosen, 1)], "feature string, place int, score double")


def block_bootstrap(values: np.ndarray, samples: int, block: int, seed: int) -> tuple[float, float, float]:
    """(2.5 %, 97.5 %, share at or below 0) of means of resampled blocks."""
    if len(values) < 2:
        return 0.0, 0.0, 1.0
    rng = np.random.default_rng(seed)
    size = max(1, min(block, len(values)))
    starts = rng.integers(0, max(1, len(values) - size + 1), (samples, -(-len(values) // size)))
    means = values[(starts[..., None] + np.arange(size)).reshape(samples, -1)[:, : len(values)]].mean(axis=1)
    return float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975)), float(((means <= 0).sum() + 1) / (samples + 1))


def signed_ic_features(df: DataFrame, features: list[str], target: str, family: dict[str, str], seed: int, most: int = 12, rate: float = 0.1, limit: float = 0.85, family_cap: int = 3, samples: int = 500, block: int = 10, date: str = "trade_date") -> DataFrame:
    """(feature, direction, weight, lower): features whose signed mean daily correlation passes a block bootstrap and the false discovery
    rate, by the interval's lower end, without near copies and within the family's cap; weights in proportion to the mean."""
    long = df.select(date, target, *features).unpivot([date, target], features, "feature", "value").filter(f"value is not null and {target} is not null")
    ic: dict[str, list[float]] = {}
    for r in evaluation.daily_ic(long, ["feature", date], "value", target).orderBy("feature", date).toLocalIterator():  # a number a feature and date
        ic.setdefault(r["feature"], []).append(r["ic"])
    audit = {}
    for k, f in enumerate(sorted(ic)):
        x = np.array(ic[f])
        sign = 1 if x.mean() >= 0 else -1
        audit[f] = (sign, float(x.mean() * sign), *block_bootstrap(x * sign, samples, block, seed + k))
    passed = evaluation.benjamini_hochberg({f: a[4] for f, a in audit.items()}, rate)
    live = {f: audit[f][2] for f in passed if audit[f][2] > 0}
    chosen = evaluation.greedy_selection(live, rank_correlations(df, sorted(live)), family, most, limit, family_cap) if live else []
    total = sum(audit[f][1] for f in chosen)
    return df.sparkSession.createDataFrame([(f, audit[f][0], audit[f][1] / total, audit[f][2]) for f in chosen], "feature string, direction int, weight double, lower double")


def clustered_probability(df: DataFrame, cluster: str, value: str, family: str, samples: int, seed: int) -> float | None:
    """Share of resamples of whole clusters (years) whose mean is over 0; only each cluster's sum and count leave Spark. None with fewer than two."""
    rows = df.filter(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n")).orderBy(cluster).collect()
    if len(rows) < 2:
        return None
    s, n = np.array([r["s"] for r in rows]), np.array([r["n"] for r in rows])
    rng = np.random.default_rng(seed + int(hashlib.sha256(family.encode()).hexdigest()[:8], 16) % 100_000)
    picks = rng.integers(0, len(rows), (samples, len(rows)))
    return float((s[picks].sum(axis=1) / n[picks].sum(axis=1) > 0).mean())


def confidence(quality: str | Column, support: str | Column, agreement: str | Column, data: str | Column, stability: str | Column, outside: str | Column) -> Column:
    """Confidence of a prediction from five parts; at most 0.49 with fewer than 100 samples or outside the training range."""
    raw = 0.30 * col(quality) + 0.20 * F.least(F.greatest(col(support) / 500, F.lit(0.0)), F.lit(1.0)) + 0.20 * col(agreement) + 0.15 * col(data) + 0.15 * col(stability)
    held = F.when((col(support) < 100) | truth(col(outside)), F.least(raw, F.lit(0.49))).otherwise(raw)
    return F.least(F.greatest(held, F.lit(0.0)), F.lit(1.0))


def drift_windows(daily: DataFrame, by: list[str], date: str, metric: str, windows: dict[int, int], warning: float, quarantine: float) -> DataFrame:
    """Mean of a metric over windows of calendar days up to each date: `metric_<days>d`, and its state: insufficient_evidence below
    the window's least number of rows, else quarantine, warning or available by the upper thresholds."""
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    d = daily.withColumn("__day", day)
    for days, least in windows.items():
        w = W.partitionBy(*by).orderBy("__day").rangeBetween(-(days - 1), 0)
        d = d.withColumn(f"{metric}_{days}d", F.avg(metric).over(w))
        mean = F.col(f"{metric}_{days}d")
        d = d.withColumn(f"state_{days}d", F.when(F.count(metric).over(w) < least, "insufficient_evidence").when(mean >= quarantine, "quarantine").when(mean >= warning, "warning").otherwise("available"))
    return d.drop("__day")


def gate(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """`reasons` (names of the rules that do not hold, in order) and `admitted` (none). A missing value fails its rule."""
    reasons = F.array_compact(F.array(*[F.when(~truth(ok), F.lit(name)) for name, ok in rules]))
    return df.withColumn("reasons", reasons).withColumn("admitted", F.size("reasons") == 0)
