"""Paired increment tests and weights from covariances against plain loops and enumeration."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import allocation as alloc
from panelforge.operators import increment as incr


@pytest.fixture(scope="module")
def panel():
    """48 dates of 12 codes; y follows x a little and the event e a lot."""
    rng = np.random.default_rng(4)
    days = pd.date_range("2024-01-01", periods=60).strftime("%Y%m%d").tolist()
    rows = []
    for i in range(48):
        for k in range(12):
            x, e = rng.normal(), float(rng.random() < 0.3) * rng.choice([-1.0, 1.0])
            rows.append((f"c{k:02}", days[i], days[i + 4], x, e, 0.02 * x + 0.05 * e + 0.02 * rng.normal(), 1.0 if i >= 4 else 0.0))
    return pd.DataFrame(rows, columns=["code", "trade_date", "label_end", "x", "e", "y", "covered"])


def draw(seed, *parts):
    return int(hashlib.md5(":".join([str(seed), *map(str, parts)]).encode()).hexdigest()[:8], 16)


def splits(pdf, folds, embargo):
    dates = sorted(pdf["trade_date"].unique())
    size = len(dates) // (folds + 1)
    for k in range(folds):
        first = size * (k + 1)
        last = len(dates) if k == folds - 1 else first + size
        train = pdf[pdf["trade_date"].isin(dates[: max(0, first - embargo)]) & (pdf["label_end"] < dates[first])]
        yield k, train, pdf[pdf["trade_date"].isin(dates[first:last])]


def ridge(train, names, penalty):
    a = np.column_stack([np.ones(len(train)), train[names].to_numpy()])
    return np.linalg.solve(a.T @ a + penalty * np.diag([0.0] + [1.0] * len(names)), a.T @ train["y"].to_numpy())


def spearman(a, b):
    return np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1]


def test_support_equals_a_loop(spark, panel):
    got = incr.support(spark.createDataFrame(panel), ["e"], coverage="covered").first()
    on = panel[(panel["e"].abs() > 1e-12) & (panel["covered"] > 0)]
    assert (got["rows"], got["dates"], got["covered_rows"], got["active_rows"], got["active_dates"]) == (len(panel), 48, 44 * 12, len(on), on["trade_date"].nunique())
    assert got["status"] == "supported"
    none = incr.support(spark.createDataFrame(panel).filter("false"), ["e"]).first()
    assert (none["rows"], none["active_ratio"], none["status"]) == (0, 0.0, "insufficient_support")


def test_increment_equals_loops(spark, panel):
    horizon, samples, block, seed, cost = 4, 300, 3, 9, 0.0015
    got = incr.increment(spark.createDataFrame(panel), ["x"], ["e"], "y", "label_end", horizon, coverage="covered", folds=3, samples=samples, block=block, seed=seed, least_dates=5, least_rows=20).first()
    parts = []
    for _, train, valid in splits(panel, 3, horizon):
        b, c = ridge(train, ["x"], 1.0), ridge(train, ["x", "e"], 1.0)
        parts.append(valid.assign(base=b[0] + b[1] * valid["x"], candidate=c[0] + c[1] * valid["x"] + c[2] * valid["e"], w=c[2]))
    v = pd.concat(parts)
    dates = sorted(v["trade_date"].unique())
    net, turn = {}, {}
    for score in ("base", "candidate"):
        held, net[score], turn[score] = set(), [], []
        for day in dates[::horizon]:
            d = v[v["trade_date"] == day].sort_values([score, "code"], ascending=[False, True])
            top = d.head(max(1, int(len(d) * 0.2)))
            t = 1 - len(held & set(top["code"])) / len(top)
            held = set(top["code"])
            net[score].append(top["y"].mean() - d["y"].mean() - t * cost)
            turn[score].append(t)
    ics = {s: np.mean([spearman(d[s], d["y"]) for _, d in v.groupby("trade_date")]) for s in ("base", "candidate")}
    assert got["status"] == "complete" and got["periods"] == len(dates[::horizon])
    assert got["delta_rank_ic"] == pytest.approx(ics["candidate"] - ics["base"])
    many = 252 / horizon
    assert got["delta_net_excess_return"] == pytest.approx((np.mean(net["candidate"]) - np.mean(net["base"])) * many)
    assert got["delta_annual_turnover"] == pytest.approx((np.mean(turn["candidate"]) - np.mean(turn["base"])) * many)
    ratio = {s: np.mean(net[s]) / np.std(net[s], ddof=1) * many**0.5 for s in net}
    assert got["delta_portfolio_sharpe"] == pytest.approx(ratio["candidate"] - ratio["base"])
    fall = {s: max(0.0, *(1 - np.cumprod(1 + np.array(net[s])) / np.maximum(np.maximum.accumulate(np.cumprod(1 + np.array(net[s]))), 1.0))) for s in net}
    assert got["delta_max_drawdown"] == pytest.approx(fall["candidate"] - fall["base"])
    diff = np.array(net["candidate"]) - np.array(net["base"])
    n, k = len(diff), -(-len(diff) // block)
    means = [sum(diff[s : s + block].sum() for s in (draw(seed, i, j) % (n - block + 1) for j in range(k))) / (block * k) for i in range(samples)]
    assert (got["mean_delta"], got["low"], got["high"]) == pytest.approx((diff.mean(), np.quantile(means, 0.025), np.quantile(means, 0.975)))
    before, after = [], []
    for day, d in v.groupby("trade_date"):
        d = d.sort_values("code")
        order = sorted(d["code"], key=lambda c: (draw(seed, "e", c, day), c))
        dealt = d.set_index("code").loc[order, "e"].to_numpy()
        before.append(spearman(d["candidate"], d["y"]))
        after.append(spearman(d["candidate"] + d["w"] * (dealt - d["e"].to_numpy()), d["y"]))
    assert got["importance"] == pytest.approx(np.mean(before) - np.mean(after)) and got["importance"] > 0
    assert got["top_feature"] == "e" and got["admitted"] == (not got["reasons"])


def test_increment_without_support_fits_nothing(spark, panel):
    got = incr.increment(spark.createDataFrame(panel), ["x"], ["e"], "y", "label_end", 4, coverage="covered", least_rows=10**6).first()
    assert got["status"] == "insufficient_support" and got["delta_rank_ic"] is None and not got["admitted"] and "support" in got["reasons"]


def test_paired_bootstrap_of_nothing_and_of_one_period(spark):
    kind = "d string, a double, b double"
    none = incr.paired_bootstrap(spark.createDataFrame([], kind), "d", "a", "b", 50, 5, 1).first()
    assert (none["periods"], none["low"]) == (0, None)
    one = incr.paired_bootstrap(spark.createDataFrame([("1", 1.0, 3.0)], kind), "d", "a", "b", 50, 5, 1).first()
    assert (one["periods"], one["mean_delta"], one["low"], one["high"], one["positive"]) == (1, 2.0, 2.0, 2.0, 1.0)


@pytest.fixture(scope="module")
def returns():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 5)) * 0.01
    rows = [("A", f"n{j}", f"d{i:02}", float(x[i, j])) for i in range(40) for j in range(5) if (i, j) not in {(3, 1), (7, 4)}]
    return pd.DataFrame([*rows, ("B", "n0", "d00", 0.01), ("B", "n0", "d01", None)], columns=["account", "name", "day", "r"])


def test_pair_sums_and_correlations_equal_pandas(spark, returns):
    got = alloc.covariances(alloc.pair_sums(spark.createDataFrame(returns), "account", "name", "day", "r"), 3).toPandas()
    wide = returns[returns["account"] == "A"].pivot(index="day", columns="name", values="r")
    assert set(got["account"]) == {"A"} and len(got) == 15
    for r in got.itertuples():
        both = wide[[r.a, r.b]].dropna() if r.a != r.b else wide[[r.a]].dropna()
        assert r.n == len(both)
        assert r.cov == pytest.approx(np.cov(both[r.a], both[r.b])[0, 1]) and r.corr == pytest.approx(np.corrcoef(both[r.a], both[r.b])[0, 1])


def test_shrunk_covariance_follows_ledoit_and_wolf(spark, returns):
    got = alloc.shrunk(spark.createDataFrame(returns).filter("account = 'A'"), "account", "name", "day", "r").toPandas()
    x = returns[returns["account"] == "A"].pivot(index="day", columns="name", values="r").dropna().to_numpy()
    x = x - x.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum()
    b2 = min(d2, sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / n**2)
    want = b2 / d2 * mu * np.eye(p) + (1 - b2 / d2) * s
    assert got["shrinkage"].iloc[0] == pytest.approx(b2 / d2)
    for r in got.itertuples():
        assert r.cov == pytest.approx(want[int(r.a[1]), int(r.b[1])])


def test_budget_projection_keeps_caps_and_uses_what_fits():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        w, groups = rng.random(n) * (rng.random(n) < 0.8), rng.integers(0, 3, n)
        cap, group_cap, budget = rng.uniform(0.1, 0.6), rng.uniform(0.2, 0.7), rng.uniform(0.3, 1.0)
        out = alloc.project_budget(w, cap, budget, groups, group_cap)
        by_group = np.bincount(groups, out, 3)
        assert (out <= cap + 1e-12).all() and (by_group <= group_cap + 1e-12).all() and out.sum() <= budget + 1e-12 and (out[w == 0] == 0).all()
        room = (w > 0) & (out < cap - 1e-9) & (by_group[groups] < group_cap - 1e-9)
        assert abs(out.sum() - budget) < 1e-9 or not room.any()
        if room.sum() > 1:  # names that no cap holds back stay in proportion
            assert np.ptp(out[room] / w[room]) < 1e-9
    assert alloc.project_budget(np.array([]), 0.5, 1.0).size == 0


def random_book(rng, n):
    x = rng.normal(size=(30, n)) * 0.05
    pdf = pd.DataFrame({"name": [f"n{i}" for i in range(n)], "alpha": rng.normal(0.01, 0.02, n), "liquidity_cap": rng.uniform(0.1, 0.6, n), "current": rng.dirichlet(np.ones(n)) * 0.5, "benchmark": rng.dirichlet(np.ones(n)), "cost_bps": rng.uniform(0, 40, n), "kind": rng.choice(["u", "v"], n), "beta": rng.uniform(0, 2, n)})
    return pdf, x.T @ x / 30


def test_exact_supports_equal_enumeration():
    rng = np.random.default_rng(11)
    told = set()
    for k in range(12):
        pdf, cov = random_book(rng, 6)
        limits = alloc.Limits(positions=3, name=0.45, gross=0.9, turnover=[1.0, 0.4][k % 2], tracking_error=[None, 0.03][k % 3 == 0], groups={"kind": 0.5}, exposures={"beta": 0.8}, target_gross=[0.0, 0.6][k % 2])
        b = alloc.Book(pdf, cov, "name", limits, 4.0, 1.0, 1.0)
        got, want = b.exact(), alloc.enumerated(b.tracked, b.objective, 6, 3)
        assert (got is None) == (want is None)
        if want is None:
            continue
        assert b.objective(got) == pytest.approx(b.objective(want), abs=1e-7)
        assert (got > alloc.SMALL).sum() <= 3 and got.sum() <= 0.9 + 1e-6 and b.turnover(got) <= limits.turnover + 1e-6 and (got <= b.cap + 1e-6).all()
        assert all(v @ got <= c + 1e-6 for _, v, c in b.sums) and (limits.tracking_error is None or b.tracking_error(got) <= 0.03 + 1e-6)
        told.update(x.split(":")[0] for x in b.binding(got))
    assert {"group", "max_turnover", "max_positions"} <= told


def test_relaxed_weights_cannot_be_improved():
    """No feasible point near the solution or anywhere between it and random feasible points has a better objective."""
    rng = np.random.default_rng(3)
    pdf, cov = random_book(rng, 5)
    b = alloc.Book(pdf, cov, "name", alloc.Limits(positions=5, gross=0.8, turnover=0.5, groups={"kind": 0.6}), 4.0, 1.0, 1.0)
    w = b.relaxed(np.ones(5, bool))
    found = 0
    for _ in range(20_000):
        v = np.clip(w + rng.normal(size=5) * rng.choice([0.001, 0.05, 0.3]), 0, b.cap)
        if v.sum() <= 0.8 and b.turnover(v) <= 0.5 and all(x @ v <= c for _, x, c in b.sums):
            found += 1
            assert b.objective(v) <= b.objective(w) + 1e-8
    assert found > 1000


def test_constrained_weights_say_why_all_is_cash(spark, returns):
    cov = alloc.shrunk(spark.createDataFrame(returns), "account", "name", "day", "r")
    names = [(a, f"n{i}", al) for a, al in (("A", 0.05), ("C", 0.05), ("D", -1.0)) for i in range(5)]
    book = spark.createDataFrame(names, "account string, name string, alpha double")
    cov = cov.unionByName(cov.filter("account = 'A'").replace("A", "D", "account"))
    got = {r["account"]: r for r in alloc.constrained_weights(book, cov, "account", "name", alloc.Limits(positions=2, name=0.3), 1.0).collect()}
    assert got["A"]["fallback"] is None and "max_positions" in got["A"]["binding"] and got["A"]["cash"] == pytest.approx(0.4, abs=1e-6)
    assert got["C"]["fallback"] == "missing_covariance" and got["C"]["binding"] == ["fail_closed"]
    assert got["D"]["fallback"] == "non_positive_net_utility" and got["D"]["weight"] == 0.0


def test_covariance_weights_equal_a_loop(spark, returns):
    cov = alloc.shrunk(spark.createDataFrame(returns).filter("account = 'A'"), "account", "name", "day", "r")
    pdf = pd.DataFrame({"account": "A", "name": [f"n{i}" for i in range(5)], "volatility": [0.1, 0.2, None, 0.4, 3.0], "expected": [0.1, -0.1, None, 0.05, 0.0], "confidence": [0.5, 0.9, None, 0.2, 0.5], "current": [0.4, None, 0.1, 0.0, 0.0], "kind": list("uuvvv")})
    got = alloc.covariance_weights(spark.createDataFrame(pdf), cov, "account", "name", cap=0.3, budget=0.9, group="kind", group_cap=0.6, turnover_penalty=0.25, band=0.02).toPandas().sort_values("name")["weight"].to_numpy()
    vol = np.clip(np.array([0.1, 0.2, 0.3, 0.4, 3.0]), 0.3 / 4, 1.2)
    inv = 1 / vol
    z = pdf["expected"] * pdf["confidence"] / vol
    fit = lambda w: alloc.project_budget(np.asarray(w), 0.3, 0.9, pdf["kind"].to_numpy(), 0.6)
    anchor = w = fit(np.clip(inv / np.median(inv), 0.5, 2) * alloc.tilt(z.to_numpy()))
    s = alloc.matrix(pdf["name"].tolist(), cov.toPandas())
    s = s / np.median(np.diag(s))
    for _ in range(40):
        w = 0.5 * anchor + 0.5 * fit((anchor + 1e-8) / np.sqrt(np.diag(s) + np.maximum(s @ w, 0) + 1e-8))
    w = fit(w)
    held = pdf["current"].fillna(0).to_numpy()
    assert got == pytest.approx(fit(np.where(np.abs(w - held) < 0.02, held, 0.75 * w + 0.25 * held)))
    assert (got <= 0.3 + 1e-9).all() and got.sum() == pytest.approx(0.9)


def test_stress_losses():
    got = alloc.stress_losses({"market_beta": 1.0, "fx_beta": -0.5}, {"x": 0.4, "y": 0.2})
    assert got == pytest.approx({"market": 0.2, "industry": 0.06, "volatility": 0.0, "fx": 0.0, "premium": 0.0})
