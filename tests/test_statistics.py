"""Resampling, calibration and settlement operators against plain loops over the same rows."""

import hashlib
import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import evaluation, learning, portfolio


def test_clustered_probability_resamples_whole_clusters(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"year": rng.integers(2015, 2022, 90), "x": rng.normal(0.05, 1, 90)})
    got = learning.clustered_probability(spark.createDataFrame(pdf), "year", "x", "earnings", 300, 5)
    years = sorted(pdf["year"].unique())
    draw = np.random.default_rng(5 + int(hashlib.sha256(b"earnings").hexdigest()[:8], 16) % 100_000)
    hits = 0
    for row in draw.integers(0, len(years), (300, len(years))):
        sample = pd.concat([pdf[pdf["year"] == years[i]] for i in row])
        hits += sample["x"].mean() > 0
    assert got == pytest.approx(hits / 300) and 0 < got < 1
    assert learning.clustered_probability(spark.createDataFrame(pdf[pdf["year"] == 2015]), "year", "x", "earnings", 9, 5) is None


def test_calibration_slope_has_the_most_likelihood(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    y = rng.random(500) < 1 / (1 + np.exp(-(0.3 + 0.6 * x)))
    p = 1 / (1 + np.exp(-x))
    got = evaluation.calibration_slope(spark.createDataFrame(pd.DataFrame({"p": p, "y": y})), "p", "y")

    def best_likelihood(b):
        a = min(np.linspace(-1, 2, 3001), key=lambda a: -np.sum(np.where(y, a + b * x, 0) - np.log1p(np.exp(a + b * x))))
        return np.sum(np.where(y, a + b * x, 0) - np.log1p(np.exp(a + b * x)))

    assert all(best_likelihood(got) >= best_likelihood(got + d) - 1e-6 for d in (-0.05, -0.01, 0.01, 0.05)) and 0.3 < got < 0.9


def test_edge_calibration_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{d:02}", f"c{c:02}", float(rng.normal()), 0.0) for d in range(20) for c in range(11)]
    rows = [(d, c, s, 0.3 * s + float(rng.normal())) for d, c, s, _ in rows] + [("d00", "none", None, 1.0), ("d01", "none", 1.0, None)]
    got = learning.edge_calibration(spark.createDataFrame(rows, "trade_date string, code string, s double, r double"), "s", "r", "trade_date", 4, 5).orderBy("bucket").collect()
    buckets = {}
    for day in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == day and r[2] is not None and r[3] is not None), key=lambda r: (r[2], r[1]))
        base, extra, at = len(own) // 4, len(own) % 4, 0
        for b in range(4):
            part = own[at : at + base + (b < extra)]
            at += len(part)
            if part:
                buckets.setdefault(b + 1, []).append(np.mean([r[3] for r in part]))
    means = [np.mean(buckets[b]) for b in sorted(buckets)]
    level = [[m, len(buckets[b]), 1] for m, b in zip(means, sorted(buckets))]
    i = 0
    while i + 1 < len(level):
        if level[i][0] > level[i + 1][0]:
            (m, w, k), (m2, w2, k2) = level[i], level[i + 1]
            level[i : i + 2] = [[(m * w + m2 * w2) / (w + w2), w + w2, k + k2]]
            i = max(0, i - 1)
        else:
            i += 1
    fitted = [m for m, _, k in level for _ in range(k)]
    assert [r["dates"] for r in got] == [len(buckets[b]) for b in sorted(buckets)]
    assert [r["mean"] for r in got] == pytest.approx(means) and [r["fitted"] for r in got] == pytest.approx(fitted)
    assert [r["error"] for r in got] == pytest.approx([np.std(buckets[b], ddof=1) / math.sqrt(max(len(buckets[b]) / 5, 1)) for b in sorted(buckets)])


def test_deflated_sharpe_is_the_published_formula():
    trials = [0.4, 1.1, -0.2, 0.8, 1.5]
    z = NormalDist()
    sd = np.std(trials, ddof=1) / math.sqrt(252)
    best = sd * ((1 - 0.5772156649015329) * z.inv_cdf(1 - 1 / 5) + 0.5772156649015329 * z.inv_cdf(1 - 1 / (5 * math.e)))
    s = 1.5 / math.sqrt(252)
    want = z.cdf((s - best) * math.sqrt(999) / math.sqrt(1 + 0.3 * s + (4.2 - 1) / 4 * s * s))
    assert evaluation.deflated_sharpe(1.5, trials, 1000, -0.3, 4.2) == pytest.approx(want)


def test_overfit_probability_equals_a_loop_over_returns():
    rng = np.random.default_rng(4)
    returns = rng.normal(0.001, 0.01, (6, 8, 30))
    sums = np.stack([np.full((6, 8), 30.0), returns.sum(axis=2), (returns**2).sum(axis=2)], axis=2)
    below = []
    for inside in itertools.combinations(range(8), 4):
        outside = [b for b in range(8) if b not in inside]
        ratio = lambda bs, k: returns[k, list(bs)].mean() / returns[k, list(bs)].std()
        best = max(range(6), key=lambda k: ratio(inside, k))
        rank = sum(ratio(outside, k) < ratio(outside, best) for k in range(6)) / 5
        below.append(rank < 0.5)
    assert evaluation.overfit_probability(sums) == pytest.approx(np.mean(below))


def test_stationary_bootstrap_walks_in_blocks():
    values = np.arange(40.0) - 19
    rng = np.random.default_rng(7)
    hits, runs, steps = 0, 0, 0
    for _ in range(120):
        at, total = rng.integers(40), 0.0
        for _ in range(40):
            total += values[at]
            jump = rng.random() < 1 / 8
            runs, steps = runs + jump, steps + 1
            at = rng.integers(40) if jump else (at + 1) % 40
        hits += total / 40 > 0.5
    assert evaluation.stationary_bootstrap(values, 8.0, 120, 7, 0.5) == hits / 120
    assert abs(runs / steps - 1 / 8) < 0.01  # blocks of 8 on average


def test_settlement_equals_a_queue_by_hand(spark):
    rng = np.random.default_rng(6)
    orders = [("A" if rng.random() < 0.5 else "B", f"d{rng.integers(12):02}", "sell" if rng.random() < 0.4 else "buy", float(rng.integers(1, 60))) for _ in range(120)]
    got = {(r["account"], r["trade_date"]): (r["free_cash"], r["receivable"], r["filled"], r["rejected"]) for r in portfolio.settlement(spark.createDataFrame(orders, "account string, trade_date string, side string, value double"), "account", 100.0, 2).collect()}
    want = {}
    for account in "AB":
        cash, due = 100.0, []
        for i, day in enumerate(sorted({o[1] for o in orders if o[0] == account})):
            cash += sum(v for at, v in due if at == i)
            own = [o for o in orders if o[0] == account and o[1] == day]
            filled = rejected = 0
            for value in sorted(o[3] for o in own if o[2] == "buy"):
                if value <= cash:
                    cash, filled = cash - value, filled + 1
                else:
                    rejected += 1
            for o in own:
                if o[2] == "sell":
                    due.append((i + 2, o[3]))
                    filled += 1
            want[account, day] = (cash, sum(v for at, v in due if at > i), filled, rejected)
    assert got == want
    assert sum(w[3] for w in want.values()) > 5


