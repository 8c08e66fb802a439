"""What failed on larger or flatter tables: values against plain loops, plans without what had grown."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import allocation, capacity, evaluation, features, increment, labels, learning, ranking, roll
from panelforge.plans import catalog
from panelforge.plans.base import rounded


def test_correlation_where_one_side_does_not_vary(spark):
    data = [("a", f"{i:03d}", 0.1 if i < 30 else float(i * i % 11), None if i == 3 else float(i % 7)) for i in range(50)]
    d = spark.createDataFrame(data, "code string, trade_date string, x double, y double")
    got = rounded(d.select("trade_date", roll.rolling_corr("x", "y", 5, flat=float("nan")).alias("c"), roll.rolling_corr("x", "y", 5).alias("n"))).orderBy("trade_date").collect()
    for i, r in enumerate(got):
        part = [x[2:] for x in data[max(0, i - 4) : i + 1] if x[3] is not None]
        if len(part) < 5:
            assert r["c"] is None and r["n"] is None
        elif len({x for x, _ in part}) == 1:
            assert math.isnan(r["c"]) and r["n"] is None
        else:
            assert r["c"] == r["n"] == pytest.approx(np.corrcoef(np.array(part).T)[0, 1], abs=2e-6)
    assert evaluation.daily_ic(d.withColumn("x", F.lit(1.0)), ["code"], "x", "y").collect() == []


def test_quantiles_of_columns_equal_sorting(spark):
    rng = np.random.default_rng(3)
    x, y = rng.standard_cauchy(9000), rng.integers(0, 4, 9000) * 1.0
    d = spark.createDataFrame([(float(a), None if i % 3 else float(b), None) for i, (a, b) in enumerate(zip(x, y))], "a double, b double, c double").repartition(7)
    cuts = [0.0, 0.01, 0.5, 0.512, 0.99, 1.0]
    of = {c: F.col(c) for c in "abc"}
    got = learning.column_quantiles(d, of, cuts, accuracy=50)
    assert got == learning.column_quantiles(d, of, cuts) and got["c"] == []
    assert got["a"] == pytest.approx(np.quantile(x, cuts), rel=1e-12) and got["b"] == pytest.approx(np.quantile(y[::3], cuts))
    assert learning.column_quantiles(d.filter("a > 1e9"), of, cuts) == {"a": [], "b": [], "c": []}


def test_training_statistics_do_not_collect_the_values(spark):
    """No aggregate keeps each value of a column, and the rows are computed once."""
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    d = spark.createDataFrame([(i, float(i % 17), float(i)) for i in range(600)], "i int, a double, b double").mapInPandas(told, "i int, a double, b double")
    out = learning.imputed(d, F.col("i") < 400, ["a", "b"])
    rows = out.orderBy("i").collect()
    assert seen.value == 600 and "percentile(" not in out._jdf.queryExecution().toString()
    b = np.clip(np.arange(600.0), *np.quantile(np.arange(400.0), [0.01, 0.99]))
    assert [r["b"] for r in rows] == pytest.approx((b - b[:400].mean()) / b[:400].std())


def test_rows_that_stand_for_equal_ones_get_their_gradients():
    rng = np.random.default_rng(5)
    rel, many = rng.integers(0, 4, 60) * 1.0, rng.integers(1, 5, 60)
    score = rng.choice([-1.5, 0.0, 0.25, 80.0], 60)
    got = ranking.lambdas(score, rel, many)
    each = np.repeat(np.arange(60), many)
    for a, b in zip(got, ranking.lambdas(score[each], rel[each])):
        assert a == pytest.approx(np.bincount(each, b), abs=1e-12)


def test_gradients_of_a_large_date_take_no_pairs_of_rows():
    """Half a million rows of a date: all pairs would take hours."""
    rng = np.random.default_rng(6)
    n, began = 500_000, time.process_time()
    g, h = ranking.lambdas(rng.integers(0, 200, n) / 100, rng.integers(0, 4, n) * 1.0)
    assert time.process_time() - began < 60 and abs(g.sum()) < 1e-6 and (h >= -1e-12).all()


def test_feature_view_moves_rows_once(spark):
    """A row is not repeated for each feature: one exchange, by date, of rows as wide as the panel."""
    d = spark.createDataFrame([(f"c{i}", f"d{i % 3}", "ab"[i % 2], float(i % 5), float(i % 4), 1.0) for i in range(60)], "code string, trade_date string, industry string, return_1 double, roe double, total_mv double")
    out = features.feature_view(d)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Expand" not in plan and "Join" not in plan
    got = {r["code"]: r for r in out.collect()}
    for k in ("d0", "d1", "d2"):
        part = [r for r in d.collect() if r["trade_date"] == k]
        rank = lambda xs, x: (sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2) / len(xs)
        for r in part:
            near = [x["roe"] for x in part if x["industry"] == r["industry"]]
            assert got[r["code"]]["roe_industry_rank"] == pytest.approx(rank(near, r["roe"]) - sum(rank(near, x) for x in near) / len(near))
            assert got[r["code"]]["market_breadth_1"] == pytest.approx(sum(x["return_1"] > 0 for x in part) / len(part))


def test_only_pairs_of_selected_codes_are_formed(spark):
    rng = np.random.default_rng(8)
    data = [("s", "x", f"d{t:02d}", f"c{c:02d}", f"i{c % 4}", float(c if c < 36 else rng.normal(50)), float(rng.normal() + t % 5)) for t in range(20) for c in range(40)]
    d = spark.createDataFrame(data, "strategy string, account string, trade_date string, code string, industry string, score double, ret double")
    returns = d.select("code", "trade_date", "account", "ret")
    place = ([2, 3], ["strategy", "account"], "trade_date", "code", "industry", "score")
    own = capacity.ever_selected(returns, d, *place)
    codes = {r["code"] for r in own.select("code").distinct().collect()}
    selected = capacity.selections(d, *place)
    assert codes == {r["code"] for r in selected.select("code").distinct().collect()} and len(codes) < 10
    of = lambda r: allocation.covariances(allocation.pair_sums(r, "account", "code", "trade_date", "ret"), 12).filter("a < b")
    a, b = (sorted(map(tuple, capacity.correlated(selected, of(r), ["strategy", "account"], "code", 0.6).collect())) for r in (own, returns))
    assert a == b and of(own).count() < of(returns).count() / 10


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_labels_are_not_moved_for_their_benchmark(spark):
    p = spark.createDataFrame([("a", f"d{i:02d}", 1.0, 1.0, 1.0, 1.0) for i in range(30)], "code string, trade_date string, open double, high double, low double, close double")
    grown = p.groupBy("trade_date").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))
    out = labels.forward_labels(p, grown)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == sum(30 - h for h in labels.HORIZONS)


def test_feature_audit_equals_loops(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"code": [f"c{i % 12}" for i in range(240)], "trade_date": [f"d{i // 12:02d}" for i in range(240)], "y": rng.normal(size=240), "a": rng.integers(0, 4, 240) * 1.0, "b": 1.0})
    pdf.loc[rng.random(240) < 0.2, "a"] = np.nan
    pdf.loc[rng.random(240) < 0.1, "y"] = np.nan
    d = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "code string, trade_date string, y double, a double, b double")
    got = {r["feature"]: r for r in learning.feature_audit(d, ["a", "b"], "y").collect()}
    day = pdf.groupby("trade_date")
    r, t = (day[c].rank(pct=True) - day[c].rank(pct=True).groupby(pdf["trade_date"]).transform("mean") for c in ("a", "y"))
    assert got["a"]["coverage"] == pytest.approx(pdf["a"].notna().mean()) and got["a"]["correlation"] == pytest.approx((r * t).sum() / np.sqrt((r**2).sum() * (t**2).sum()))
    ic = day[["a", "y"]].apply(lambda g: g.dropna()["a"].rank().corr(g.dropna()["y"].rank()))
    assert got["a"]["ic_t"] == pytest.approx(ic.mean() / ic.std() * len(ic) ** 0.5)
    means = [ic.iloc[k].mean() for k in (slice(0, 7), slice(7, 14), slice(14, 20))]
    assert got["a"]["stability"] == pytest.approx(np.mean([np.sign(m) == np.sign(got["a"]["correlation"]) for m in means]))
    assert (got["b"]["ic_t"], got["b"]["stability"]) == (None, 0.0)


def test_overfitting_of_many_trials_without_collecting_them(spark):
    rng = np.random.default_rng(10)
    m = 300
    x = np.stack([rng.integers(5, 9, (m, 8)) * 1.0, rng.normal(0, 0.1, (m, 8)), rng.random((m, 8)) + 0.1], axis=2)
    x[0] = x[1]  # a tie
    d = spark.createDataFrame([(f"t{i:03d}", b, *map(float, x[i, b])) for i in range(m) for b in range(8)], "account string, block int, n double, s double, q double").repartition(6)
    name, sharpe, deflated, probability = evaluation.overfitting(d, "account")
    n, s, q = x.sum(axis=1).T
    each = s / n / np.sqrt(q / n - (s / n) ** 2) * 252**0.5
    best = int(each.argmax())
    assert (name, sharpe) == (f"t{best:03d}", pytest.approx(each[best]))
    assert deflated == pytest.approx(evaluation.deflated_sharpe(float(each[best]), each.tolist(), int(n[best]), 0.0, 3.0)) and probability == evaluation.overfit_probability(x)
    assert evaluation.overfitting(d.filter("n < 0"), "account") is None


def test_rows_with_indicators_are_not_moved_by_date(spark):
    plan = catalog.QUERIES["events_all_masks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(code" in plan and "windowspecdefinition(trade_date" not in plan


def test_dealt_values_take_no_join_of_rows(spark):
    rng = np.random.default_rng(11)
    data = [(f"c{i % 9}", f"d{i // 9}", *map(float, rng.normal(size=3)), 0.5) for i in range(54)]
    scores = spark.createDataFrame(data, "code string, trade_date string, y double, candidate double, e double, w_e double")
    out = increment.permutation_importance(scores, ["e"], "y", "trade_date", "code", 7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning") == 2  # by date, then a row a feature
    hashed = {(r[0], r[1]): r[2] for r in scores.select("code", "trade_date", increment.uniform(7, F.lit("e"), "code", "trade_date")).collect()}
    gaps = []
    for k in range(6):
        part = sorted(r for r in data if r[1] == f"d{k}")
        order = sorted(part, key=lambda r: (hashed[r[0], r[1]], r[0]))
        a, b, y = [r[3] for r in part], [r[3] + 0.5 * (o[4] - r[4]) for r, o in zip(part, order)], [r[2] for r in part]
        rank = lambda v: np.argsort(np.argsort(v))
        gaps.append(np.corrcoef(rank(a), rank(y))[0, 1] - np.corrcoef(rank(b), rank(y))[0, 1])
    assert out.first()["importance"] == pytest.approx(np.mean(gaps))
