"""Panel operators on small fixtures with hand-computed values and invariants."""

import datetime as dt
import math
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import scalar
from panelforge.operators import documents, evaluation, events, labels, performance, pit, portfolio, regime, roll, technical, xsec
from panelforge.sources import store


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_keys_and_missing_values(spark):
    d = spark.createDataFrame([("2024-01-02x", "7.sz", float("nan"), "3.5"), (None, "1234567", 1.0, "x")], "d string, c string, x double, n string")
    got = d.select(scalar.date_key("d"), scalar.code_key("c"), scalar.missing_as_null("x"), scalar.to_number("n"), scalar.clip("x", 0, 0.5)).collect()
    assert [tuple(r)[:4] for r in got] == [("20240102", "000007", None, 3.5), (None, "1234567", 1.0, None)]
    assert got[1][4] == 0.5


def test_average_tie_rank_and_constant_zscore(spark):
    d = spark.createDataFrame([("d", 1.0), ("d", 1.0), ("d", 3.0), ("d", None)], "date string, x double")
    got = rows(d.select("x", xsec.pct_rank("x", ["date"]).alias("r")).na.fill(-1.0), "x")
    assert got == [(-1.0, -1.0), (1.0, 0.5), (1.0, 0.5), (3.0, 1.0)]
    flat = spark.createDataFrame([("d", 2.0), ("d", 2.0)], "date string, x double")
    assert rows(flat.select(xsec.zscore("x", ["date"]))) == [(0.0,), (0.0,)]


def test_neutralised_groups_have_mean_zero_and_scores_are_sums(spark):
    data = [("d", f"{i:03d}", "a" if i % 2 else "b", float(i), float((i * 7) % 5) if i % 3 else None) for i in range(20)]
    d = spark.createDataFrame(data, "date string, code string, industry string, x double, y double")
    scores, long = xsec.process_factors(d, ["date"], "code", "industry", {"x": (0.6, 1), "y": (0.4, -1)})
    means = long.groupBy("factor", "industry").agg(F.avg("neutral").alias("m")).collect()
    assert all(abs(r["m"]) < 1e-9 for r in means)
    sums = {r["code"]: r["s"] for r in long.groupBy("code").agg(F.sum("contribution").alias("s")).collect()}
    for r in scores.collect():
        assert math.isclose(r["score"], sums[r["code"]], abs_tol=1e-12)
        assert math.isclose(r["coverage"], 1.0 if int(r["code"]) % 3 else 0.6)


def test_asof_never_looks_ahead_and_keeps_null_fields(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "code string, t int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, None), ("a", 6, 9.0)], "code string, at int, v double")
    got = rows(pit.asof_join(left, right, ["code"], "t", "at", ["v"]), "code", "t")
    assert got == [("a", 1, None, None), ("a", 5, 5, None), ("b", 5, None, None)]


def test_membership_tests_the_newest_row_only(spark):
    left = spark.createDataFrame([("a", 5), ("a", 9)], "code string, t int")
    m = spark.createDataFrame([("a", 1, 99, "old"), ("a", 4, 7, "new")], "code string, since int, until int, ind string")
    assert rows(pit.membership_asof(left, m, ["code"], "t", "since", "until", "ind"), "t") == [("a", 5, "new"), ("a", 9, None)]


def test_duplicate_keys_raise(spark):
    d = spark.createDataFrame([("a",), ("a",)], "code string")
    with pytest.raises(Exception, match="duplicate key"):
        pit.assert_unique(d, ["code"]).collect()


def test_event_enters_after_its_day(spark):
    p = spark.createDataFrame([("a", f"2024010{i}", float(i), float(i) + 0.5) for i in range(1, 6)], "code string, trade_date string, open double, close double")
    e = spark.createDataFrame([("a", "20240102"), ("a", "20240105")], "code string, event_date string")
    got = rows(pit.next_session_entry(e, p, "code", "event_date", "trade_date", [1, 3]).select("event_date", "horizon", "entry_date", "exit_date", "ret"), "event_date", "horizon")
    assert got == [("20240102", 1, "20240103", "20240103", 3.5 / 3 - 1), ("20240102", 3, "20240103", "20240105", 5.5 / 3 - 1)]


def test_source_comparison(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.05), (2, 2.0), (4, 1.0)], "k int, v double")
    assert rows(pit.outer_compare(a, b, ["k"], {"v": 0.1}), "k") == [(1, "matched", ""), (2, "mismatch", "v"), (3, "primary_only", ""), (4, "secondary_only", "")]


def test_labels(spark):
    days = [f"202401{d:02d}" for d in range(1, 29)]
    p = spark.createDataFrame([("a", d, float(i + 1), float(i + 1), float(i + 1), float(i + 1)) for i, d in enumerate(days)], "code string, trade_date string, open double, high double, low double, close double")
    got = labels.forward_labels(p, None, horizons=(3,)).orderBy("trade_date").first()
    assert (got["entry_date"], got["exit_date"], got["ret"], got["mae"], got["label"]) == ("20240102", "20240104", 4 / 2 - 1, 0.0, "up")


def test_recursive_indicators_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    close = 50 + np.cumsum(rng.normal(size=80))
    p = spark.createDataFrame(pd.DataFrame({"code": "a", "trade_date": [f"{20240000 + i}" for i in range(80)], "high": close + 1, "low": close - 1, "close": close}))
    got = technical.recursive(p).orderBy("trade_date").toPandas()
    up = np.maximum(np.diff(close), 0)
    down = np.maximum(-np.diff(close), 0)
    a, b = up[:14].mean(), down[:14].mean()
    for i in range(14, 79):
        a, b = (a * 13 + up[i]) / 14, (b * 13 + down[i]) / 14
    assert math.isclose(got["rsi_14"].iloc[-1], 100 * a / (a + b), rel_tol=1e-9)
    assert got["rsi_14"].iloc[13] != got["rsi_14"].iloc[13] and got["ema_12"].first_valid_index() == 11 and got["macd_hist"].first_valid_index() == 33
    flat = roll.since(F.col("close") > 1e9)
    assert p.select(flat.alias("x")).filter("x is not null").count() == 0


def test_residual_momentum_uses_earlier_rows_only(spark):
    rng = np.random.default_rng(5)
    n = 60
    base = pd.DataFrame({"code": "a", "trade_date": [f"{20240000 + i}" for i in range(n)], "r": rng.normal(size=n), "m": rng.normal(size=n), "s": rng.normal(size=n)})
    changed = base.copy()
    changed.loc[n - 1, "r"] = 99.0
    one, two = (roll.residual_momentum(spark.createDataFrame(d), "r", "m", "s", 30, 10, 2).orderBy("trade_date").toPandas() for d in (base, changed))
    pd.testing.assert_frame_equal(one.iloc[: n - 1], two.iloc[: n - 1])
    x = np.column_stack([np.ones(30), base.m[n - 31 : n - 1], base.s[n - 31 : n - 1]])
    beta = np.linalg.lstsq(x, base.r[n - 31 : n - 1], rcond=None)[0]
    assert math.isclose(one["residual"].iloc[-1], base.r[n - 1] - np.array([1, base.m[n - 1], base.s[n - 1]]) @ beta, rel_tol=1e-5)


def test_hysteresis_against_a_loop(spark):
    seq = ["up", "down", "down", "unknown", "down", "up", "down", "up", "up", "up"]
    d = spark.createDataFrame([("s", f"{i:02d}", c) for i, c in enumerate(seq)], "scope string, d string, c string")
    got = [r[0] for r in rows(regime.hysteresis(d, "c", ["scope"], "d", 3).orderBy("d").select("state"))]
    assert got == ["up", "up", "up", "up", "down", "down", "down", "down", "down", "up"]


def test_fifo_matches_a_queue(spark):
    rng = np.random.default_rng(1)
    log, held = [], 0
    for i in range(60):
        side = "buy" if held < 5 or rng.random() < 0.55 else "sell"
        q = int(rng.integers(1, 9)) if side == "buy" else int(rng.integers(1, held + 1))
        held += q if side == "buy" else -q
        log.append(("p", i, side, float(q), float(rng.integers(1, 100)), f"2024-01-{1 + i % 28:02d}"))
    got = performance.fifo_matches(spark.createDataFrame(log, "p string, i int, side string, q double, price double, d string"), ["p"], ["i"], "side", "q", "price", "d").agg(F.sum("pnl"), F.sum("shares")).first()
    queue, pnl, shares = [], 0.0, 0.0
    for _, _, side, q, price, _ in log:
        if side == "buy":
            queue.append([q, price])
        while side == "sell" and q > 0:
            m = min(q, queue[0][0])
            pnl, shares, q = pnl + m * (price - queue[0][1]), shares + m, q - m
            queue[0][0] -= m
            if not queue[0][0]:
                queue.pop(0)
    assert (got[0], got[1]) == (pnl, shares)


def test_replay_keeps_cash_and_lots(spark):
    data = [("acc", f"2024010{d}", c, 10.0, 10.0 + d * 0.1, 0.5 if d == 1 else None) for d in range(1, 6) for c in ("x", "y")]
    got = portfolio.replay(spark.createDataFrame(data, "account string, trade_date string, code string, open double, close double, weight double"), "account", 10_000.0).orderBy("trade_date").toPandas()
    assert got["positions"].tolist() == [0, 2, 2, 2, 2] and (got["cash"] >= 0).all() and got["nav"].iloc[0] == 10_000.0


def test_water_fill_respects_caps():
    w = portfolio.water_fill([0.5, 0.3, 0.2], 0.4, ["a", "a", "b"], 0.6, 1.0)
    assert max(w) <= 0.4 + 1e-9 and w[0] + w[1] <= 0.6 + 1e-9 and math.isclose(sum(w), 1.0, abs_tol=1e-9)


def test_entities_events_and_text(spark):
    d = spark.createDataFrame([(1, "The Acme corp is not an idiot. Version 12"), (2, "")], "doc_id long, text string")
    got = documents.extract_events(d, [("insult", "idiot", -1), ("number", "version [0-9]+", 1)], "text", ["doc_id"])
    assert rows(got.select("doc_id", "event_type", "negated"), "event_type") == [(1, "insult", True), (1, "number", False)]
    assert documents.html_text("<html><script>x</script><p>a &amp; b</p><div>c</div></html>") == "a & b\nc"
    assert documents.html_text(None) == ""


def test_entities_as_the_reference_resolves_them(spark):
    aliases = spark.createDataFrame([("600519", "security", "600519", 1.0), ("贵州茅台", "security", "600519", 1.0), ("茅台", "security", "600519", 0.9), ("平安", "security", "000001", 0.9), ("New York Fund", "etf", "513100", 1.0), ("x", "etf", "1", 1.0)], "alias string, entity_type string, entity string, confidence double")
    rows_ = [
        (1, "公告", "今日茅台股价上涨", None, None),
        (2, "贵州茅台公告", "", None, None),
        (3, None, "the New York Fund, x", None, None),
        (4, "", "a" * 19_999 + "平安", None, None),
        (5, "", "", ["600519.SH", " "], [("159915.SZ", "创业板 ETF"), ("000002", "万科"), ("600519.SH", "茅台"), (None, None)]),
        (6, None, None, None, None),
    ]
    d = spark.createDataFrame(rows_, "k long, title string, text string, codes array<string>, links array<struct<code:string,name:string>>")
    got = sorted(tuple(r) for r in documents.resolve_entities(d, aliases, "k", "text", "title", "codes", "links").collect())
    assert got == [(1, "security", "600519", 0.9), (2, "security", "600519", 1.0), (3, "etf", "513100", 1.0), (5, "etf", "159915", 0.98), (5, "security", "000002", 0.98), (5, "security", "600519", 1.0)]


def test_novelty_against_all_earlier_whole_keys(spark):
    rng = random.Random(3)
    keys = ["same head " * 9 + "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 150))) for _ in range(24)]
    keys += [keys[0], "", keys[3] + " more"]
    d = spark.createDataFrame([(g, i, k) for g in ("a", "b") for i, k in enumerate(keys if g == "a" else keys[::-1])], "g string, at int, key string")
    for block in (64, 4):
        got = {(r["g"], r["at"]): r["novelty"] for r in documents.novelty(d, ["g"], "at", "key", block).collect()}
        for g, ks in (("a", keys), ("b", keys[::-1])):
            for i, k in enumerate(ks):
                want = 1 - max((SequenceMatcher(None, k, p, autojunk=False).ratio() for p in ks[:i]), default=0.0)
                assert math.isclose(got[g, i], want, abs_tol=1e-12)
        assert got["a", 24] == 0


def events_plain(closes):
    """Breakouts, flat stages and their changes of one code, by loops."""
    out = set()
    stage_before = ""
    for i, c in enumerate(closes):
        prior = closes[max(0, i - 20) : i]
        if len(prior) >= 3 and c > max(prior):
            out.add((i, "price_breakout_20", "neutral"))
        if len(prior) >= 3 and c < min(prior):
            out.add((i, "price_breakdown_20", "down"))
        ratio = 1.2 if i % 3 == 0 else 0.5
        move = closes[i] / closes[i - 1] - 1 if i else None
        up, down = move is not None and move > 0.005, move is not None and move < -0.005
        stage = ("volume_price_rise_" + ("confirmed" if ratio > 1 else "divergent")) if up else ("volume_price_fall_" + ("confirmed" if ratio > 1 else "exhausting")) if down else "volume_expansion_flat_price" if ratio > 1 else "volume_contraction_flat_price"
        if stage != stage_before:
            out.add((i, stage, "up" if "rise" in stage else "down" if "fall" in stage else "neutral"))
        stage_before = stage
    return out


def test_events_against_loops_and_stable_ids(spark):
    import hashlib
    import random

    rng = random.Random(3)
    closes = [round(10 * (1 + 0.01 * i * rng.choice([-1, 0, 1])), 2) for i in range(60)]
    d = spark.createDataFrame([("600001.SH", f"{i:03d}", c, 1.2 if i % 3 == 0 else 0.5) for i, c in enumerate(closes)], "code string, trade_date string, close double, volume_ratio_5_20 double")
    got = events.detect(d, "cn").collect()
    assert {(int(r["trade_date"]), r["event"], r["direction"]) for r in got} == events_plain(closes)
    assert all(r["event_id"] == hashlib.sha256(f"cn|600001|{r['trade_date']}|{r['event']}".encode()).hexdigest()[:20] and r["code"] == "600001" and r["regime"] == "unknown" for r in got)
    assert len(events.masks()) == 33


def test_statistics():
    assert evaluation.benjamini_hochberg({"a": 0.001, "b": 0.04, "c": 0.9}, 0.1) == {"a", "b"}
    assert evaluation.pool_adjacent(np.array([1.0, 3.0, 2.0]), np.ones(3)).tolist() == [1.0, 2.5, 2.5]
    assert evaluation.greedy_selection({"a": 3, "b": 2, "c": 1}, {("a", "b"): 0.99}, {}, 2, 0.9, 5) == ["a", "c"]
    assert 0.9 < evaluation.stationary_bootstrap(np.full(20, 1.0), 5, 50, 1) <= 1.0
    assert 0 <= evaluation.deflated_sharpe(1.0, [0.1, 0.5, 1.0], 250, 0.0, 3.0) <= 1
    assert 0 <= evaluation.overfit_probability(np.random.default_rng(0).random((4, 6, 3)) + 1) <= 1


def test_configs_and_health(spark):
    assert store.merged_config({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}}) == {"a": {"b": 1, "c": 3}}
    with pytest.raises(ValueError, match="locked"):
        store.merged_config({"a": {"b": 1}}, {"a": {"b": 2}}, ("a.b",))
    frames, health = store.fan_in({"x": spark.range(2), "y": RuntimeError("token=abc failed")}, "20240101")
    assert frames.count() == 2 and health[1]["detail"] == "token=*** failed"


def test_csv_scan_keeps_text_codes(spark, tmp_path):
    (tmp_path / "20240102.csv").write_text("code,close\n000300,1.5\n")
    got = store.csv_scan(spark, str(tmp_path), "code string, close double", True).first()
    assert tuple(got) == ("000300", 1.5, "20240102")


def test_upsert_and_snapshot(spark, tmp_path):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(2, 5.0)], "k int, v double")
    assert rows(store.upsert(a, b, ["k"]), "k") == [(1, 1.0), (2, 5.0)]
    assert spark.read.parquet(store.write_snapshot(a, str(tmp_path / "s"), "20240101")).schema["v"].dataType.simpleString() == "float"


def test_decay_matches_a_product(spark):
    d = [dt.date(2024, 1, i) for i in range(1, 10)]
    r = spark.createDataFrame([("a", x) for x in d], "code string, t date")
    e = spark.createDataFrame([("a", d[0], 1.0), ("a", d[4], 2.0)], "code string, et date, w double")
    got = {x["t"]: x["decayed"] for x in pit.decayed_sum(r, e, "code", "t", "et", "w", 2.0, 4).collect()}
    for x in d:
        want = sum(w * 0.5 ** ((x - t).days / 2) for t, w in ((d[0], 1.0), (d[4], 2.0)) if 0 <= (x - t).days <= 4)
        assert math.isclose(got[x], want, abs_tol=1e-12)
