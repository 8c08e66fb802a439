"""Feature views, masked sequences, capacity studies, components, hysteresis and exact quantiles against plain loops."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import capacity, documents, features, lineage, regime, strategy


def test_components_equal_union_find(spark):
    random.seed(4)
    links = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = dict(map(tuple, lineage.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == {x: find(x) for x in parent}
    assert lineage.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def state_loop(candidates, persistence):
    state = pending = None
    n, out = 0, []
    for c in candidates:
        if c not in (None, "unknown"):
            if state is None:
                state, pending, n = c, None, 0
            elif c == state:
                pending, n = None, 0
            else:
                n = n + 1 if c == pending else 1
                pending = c
                if n >= persistence:
                    state, pending, n = c, None, 0
        out.append(state)
    return out


@pytest.mark.parametrize("persistence", [1, 2, 3])
def test_hysteresis_equals_a_loop(spark, persistence):
    random.seed(persistence)
    rows = [(k, i, random.choice(["a", "b", "b", "c", "unknown", None])) for k in range(8) for i in range(60)]
    got = regime.hysteresis(spark.createDataFrame(rows, "k long, d long, c string"), "c", ["k"], "d", persistence).orderBy("k", "d").collect()
    want = [s for k in range(8) for s in state_loop([c for x, _, c in rows if x == k], persistence)]
    assert [r["state"] for r in got] == want


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_quantiles_equal_sorting(spark, accuracy):
    rng = np.random.default_rng(2)
    groups = {"one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 400 + [1.0] * 3, "many": rng.normal(size=3000).round(2).tolist(), None: rng.random(777).tolist(), "none": [None, None]}
    d = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "k string, x double").repartition(5)
    got = {r["k"]: r for r in documents.exact_quantiles(d, ["k"], "x", accuracy).collect()}
    assert set(got) == set(groups) - {"none"}
    for k, r in got.items():
        s = sorted(groups[k])
        n = len(s)
        assert (r["n"], r["median"], r["p95"]) == (n, (s[(n + 1) // 2 - 1] + s[(n + 2) // 2 - 1]) / 2, s[(95 * n + 99) // 100 - 1])


def test_feature_view_equals_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"code": [f"c{i}" for i in range(12)] * 5, "trade_date": np.repeat([f"d{i}" for i in range(5)], 12), "industry": rng.choice(["u", "v", None], 60)})
    for f in ("return_1", "momentum_20", "roe", "drawdown_60", "moneyflow_net_ratio_20"):
        pdf[f] = np.where(rng.random(60) < 0.2, None, rng.normal(size=60).round(1))
        pdf[f] = pdf[f].astype(float)
    pdf["total_mv"] = rng.normal(size=60)
    got = features.feature_view(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "code string, trade_date string, industry string, return_1 double, momentum_20 double, roe double, drawdown_60 double, moneyflow_net_ratio_20 double, total_mv double")).toPandas().sort_values(["trade_date", "code"]).reset_index(drop=True)
    pdf = pdf.sort_values(["trade_date", "code"]).reset_index(drop=True)
    pdf["log_total_mv"] = np.log(pdf["total_mv"].where(pdf["total_mv"] > 0))
    pdf["industry"] = pdf["industry"].fillna("unclassified")

    def ranked(c, by):
        r = pdf.groupby(by)[c].rank(pct=True)
        return r - r.groupby([pdf[b] for b in by]).transform("mean")

    for c in ("return_1", "momentum_20", "roe", "drawdown_60", "moneyflow_net_ratio_20", "log_total_mv"):
        assert got[f"{c}_cs_rank"].tolist() == pytest.approx(ranked(c, ["trade_date"]).tolist(), nan_ok=True)
    for c in ("momentum_20", "roe"):
        assert got[f"{c}_industry_rank"].tolist() == pytest.approx(ranked(c, ["trade_date", "industry"]).tolist(), nan_ok=True)
    assert got["roe_missing"].tolist() == pdf["roe"].isna().astype(float).tolist()
    per_day = pdf.groupby("trade_date")
    assert got["market_cross_sectional_volatility_1"].tolist() == pytest.approx(per_day["return_1"].transform("std").tolist())
    breadth = pdf["return_1"].gt(0).where(pdf["return_1"].notna()).astype(float).groupby(pdf["trade_date"]).transform("mean")
    assert got["market_breadth_1"].tolist() == pytest.approx(breadth.tolist())
    assert len(features.STOCK) == 62 and len(set(features.STOCK)) == 62


def test_sequences_are_even_and_masked(spark):
    rows = [("a", i, None if i == 2 else float(i), float("nan") if i == 3 else 1.0) for i in range(6)] + [("b", 0, 1.0, 1.0)]
    got = features.sequences(spark.createDataFrame(rows, "code string, trade_date long, x double, y double"), ["x", "y"], 4, 2).orderBy("trade_date").collect()
    assert [(r["trade_date"], r["observed"], r["values"]["x"], r["valid"]["x"], r["valid"]["y"]) for r in got] == [
        (1, 2, [0.0, 0.0, 0.0, 1.0], [0, 0, 1, 1], [0, 0, 1, 1]),
        (2, 3, [0.0, 0.0, 1.0, 0.0], [0, 1, 1, 0], [0, 1, 1, 1]),
        (3, 4, [0.0, 1.0, 0.0, 3.0], [1, 1, 0, 1], [1, 1, 1, 0]),
        (4, 4, [1.0, 0.0, 3.0, 4.0], [1, 0, 1, 1], [1, 1, 0, 1]),
        (5, 4, [0.0, 3.0, 4.0, 5.0], [0, 1, 1, 1], [1, 0, 1, 1]),
    ]
    by_industry, market = features.contexts(spark.createDataFrame([("a", 1, "u", 1.0), ("b", 1, "u", None), ("c", 1, None, 5.0)], "code string, trade_date long, industry string, x double"), ["x"])
    assert sorted(map(tuple, by_industry.collect())) == [(1, "u", 2, 1.0), (1, "unclassified", 1, 5.0)] and [tuple(r) for r in market.collect()] == [(1, 3, 3.0)]


def test_uncertainty_follows_from_quantiles_and_confidence(spark):
    rows = [("A", "a", 3.0, 0.5, 0.0, 0.05, 10.0, False, 0.01, 0.09, 0.5), ("A", "b", 2.0, 0.5, 0.0, 0.05, 10.0, False, 0.05, 0.05, 0.1), ("A", "c", 1.0, 0.5, 0.0, 0.05, 10.0, False, None, 0.09, None)]
    book = spark.createDataFrame(rows, "account string, code string, score double, aim double, current double, expected double, cost_bps double, risk_exit boolean, return_q10 double, return_q90 double, confidence double")
    got = {r["code"]: r["net_edge_bps"] for r in strategy.cost_aware_transition(book, ["account"], 3, 0.0, 0.0, 1.0, 1.0, 1.0).collect()}
    half = 0.08 / (2 * strategy.NORMAL_90) * 0.5 * 10_000
    assert got == pytest.approx({"a": 500 - 10 - half, "b": 490.0, "c": 490.0})
    given = strategy.cost_aware_transition(book.withColumn("uncertainty_bps", F.when(F.col("code") == "a", 7.0).otherwise(-1.0)), ["account"], 3, 0.0, 0.0, 1.0, 1.0, 1.0).collect()
    assert {r["code"]: r["net_edge_bps"] for r in given} == pytest.approx({"a": 483.0, "b": 490.0, "c": 490.0})


def test_selections_hold_at_most_so_many_of_an_index(spark):
    rng = random.Random(8)
    rows = [("s", f"d{d}", f"c{c:02}", f"i{c % 4}", None if rng.random() < 0.1 else round(rng.random(), 1)) for d in range(4) for c in range(14)]
    got = capacity.selections(spark.createDataFrame(rows, "s string, d string, c string, i string, x double"), [2, 5], ["s"], "d", "c", "i", "x", 2, 0.3)
    want = set()
    for day in {r[1] for r in rows}:
        live = sorted((r for r in rows if r[1] == day and r[4] is not None), key=lambda r: (-r[4], r[2]))
        kept, taken = [], {}
        for r in live:
            taken[r[3]] = taken.get(r[3], 0) + 1
            if taken[r[3]] <= 2:
                kept.append(r)
        want |= {("s", n, day, r[2], k, min(0.98 / n, 0.3), len(live)) for n in (2, 5) for k, r in enumerate(kept[:n], 1)}
    assert set(map(tuple, got.collect())) == want
