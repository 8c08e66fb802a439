"""Ranking, calibration, lineage, relocation and mentions against plain loops."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions.scalar import relocated
from panelforge.operators import calibration as calib
from panelforge.operators import evaluation, learning, lineage, mentions, ranking
from panelforge.sources import store


def test_lambdas_equal_a_loop_over_pairs(monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 3)
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 20):
        score, rel = rng.normal(size=n).round(1), rng.integers(0, 4, n).astype(float)
        place = {int(i): k for k, i in enumerate(sorted(range(n), key=lambda i: (-score[i], i)))}
        gain, disc = 2**rel - 1, [1 / np.log2(place[i] + 2) for i in range(n)]
        ideal = sum(g / np.log2(k + 2) for k, g in enumerate(sorted(gain, reverse=True)))
        g, h = np.zeros(n), np.zeros(n)
        for i in range(n):
            for j in range(n):
                if rel[i] > rel[j]:
                    rho = 1 / (1 + np.exp(score[i] - score[j]))
                    w = abs((gain[i] - gain[j]) * (disc[i] - disc[j])) / ideal
                    g[i] += w * rho
                    g[j] -= w * rho
                    h[i] += w * rho * (1 - rho)
                    h[j] += w * rho * (1 - rho)
        got = ranking.lambdas(score, rel)
        assert got[0] == pytest.approx(g) and got[1] == pytest.approx(h)


def test_histograms_and_splits_equal_loops(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"node": rng.integers(0, 3, 500), "a": rng.integers(0, 4, 500), "b": rng.integers(0, 4, 500), "g": rng.normal(size=500), "h": rng.random(500)})
    got = ranking.histograms(spark.createDataFrame(pdf).repartition(3).select(F.col("node").cast("int"), F.col("a").cast("int"), F.col("b").cast("int"), "g", "h"), ["a", "b"], 4).collect()
    want = {(n, k, b): d for k, f in enumerate("ab") for (n, b), d in pdf.groupby(["node", f])}
    assert {(r["node"], r["feature"], r["bin"]) for r in got} == set(want)
    for r in got:
        d = want[r["node"], r["feature"], r["bin"]]
        assert (r["n"], r["g"], r["h"]) == (len(d), pytest.approx(d["g"].sum()), pytest.approx(d["h"].sum()))
    sums = np.zeros((3, 2, 4))
    for r in got:
        if r["node"] == 1:
            sums[:, r["feature"], r["bin"]] = r["g"], r["h"], r["n"]
    own = pdf[pdf["node"] == 1]
    value = lambda d: d["g"].sum() ** 2 / (d["h"].sum() + 1.0)
    cuts = [(value(own[own[f] <= b]) + value(own[own[f] > b]) - value(own), k, b) for k, f in enumerate("ab") for b in range(3) if min((own[f] <= b).sum(), (own[f] > b).sum()) >= 20]
    best = max(cuts, key=lambda c: (c[0], -c[1], -c[2]))
    assert ranking.best_split(*sums, 1.0, 20) == (pytest.approx(best[0]), best[1], best[2])


def test_ranker_beats_ridge_on_a_planted_signal(spark):
    rng = np.random.default_rng(3)
    n = 60 * 30
    x = rng.normal(size=(n, 3))
    y = (np.abs(x[:, 0]) > 1) * 1.5 + 0.3 * rng.normal(size=n)  # no straight line follows it
    pdf = pd.DataFrame(x, columns=list("abc")).assign(day=np.repeat(np.arange(60), 30), y=y, id=np.arange(n))
    pdf["rel"] = pdf.groupby("day")["y"].rank(pct=True).mul(3.999).astype(int)
    d = spark.createDataFrame(pdf)
    train = F.col("day") < 40
    fitted = ranking.fit_ranker(d, train, list("abc"), "rel", "day", trees=8, depth=2, rate=0.3, count=16)
    test = ranking.ranked_scores(d, fitted).filter("day >= 40")
    ours = ranking.ndcg(test, "score", "rel", "day", "id").agg(F.avg("ndcg")).first()[0]
    line = learning.ridge_scores(d, train, list("abc"), "y", 1.0, "line").filter("day >= 40")
    theirs = ranking.ndcg(line, "line", "rel", "day", "id").agg(F.avg("ndcg")).first()[0]
    assert ours > theirs + 0.1
    gains = lambda r: sum((2**v - 1) / np.log2(k + 2) for k, v in enumerate(r[:10]))
    t = test.toPandas()
    loop = [gains(g.sort_values(["score", "id"], ascending=[False, True])["rel"].tolist()) / gains(sorted(g["rel"], reverse=True)) for _, g in t.groupby("day")]
    assert ours == pytest.approx(np.mean(loop))


@pytest.mark.parametrize("seed", range(4))
def test_isotonic_equals_pooling_in_one_pass(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 60, 400) / 7
    y = [x**0.5 + rng.normal(size=400), -x, x, rng.normal(size=400)][seed]
    w = rng.integers(1, 4, 400).astype(float)
    got = calib.isotonic(spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "w": w})), "x", "y", "w").toPandas().sort_values("low")
    g = pd.DataFrame({"x": x, "t": y * w, "w": w}).groupby("x").sum()
    want = evaluation.pool_adjacent((g["t"] / g["w"]).to_numpy(), g["w"].to_numpy())
    fitted = np.array([got[(got["low"] <= v) & (v <= got["high"])]["fitted"].iloc[0] for v in g.index])
    assert fitted == pytest.approx(want)
    assert (np.diff(got["fitted"]) > 0).all() and got["weight"].sum() == w.sum()
    at = calib.fitted_value(spark.createDataFrame([(-1.0,), (float(g.index[3]),), (99.0,), (None,)], "x double"), calib.isotonic(spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "w": w})), "x", "y", "w"), "x").toPandas()["calibrated"].tolist()
    assert at[:3] == pytest.approx([want[0], want[3], want[-1]]) and np.isnan(at[3])


def test_temperature_has_the_least_loss(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(600, 3)) * 2
    p = np.exp(z / 3) / np.exp(z / 3).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    d = spark.createDataFrame(pd.DataFrame(z, columns=["a", "b", "c"]).assign(y=y))
    got = calib.temperature(d.unionByName(spark.createDataFrame([(None, 1.0, 2.0, 1)], "a double, b double, c double, y long")), ["a", "b", "c"], "y")

    def loss(t):
        s = z / t
        return (np.log(np.exp(s).sum(axis=1)) - s[np.arange(600), y]).sum()

    assert all(loss(got) <= loss(t) + 1e-9 for t in (got * 0.99, got * 1.01, 1.0, 3.0)) and 2 < got < 4.5
    assert calib.temperature(d.filter("false"), ["a", "b", "c"], "y") == 1.0


def test_a_record_with_another_payload_raises_and_adds_nothing(spark):
    kind = "k long, a string, b double"
    old = spark.createDataFrame([(1, "x", None), (2, "y", 2.0)], kind)
    new = spark.createDataFrame([(1, "x", None), (3, "z", 1.0), (3, "z", 1.0)], kind)
    got = lineage.appended(old, new, ["k"]).collect()
    assert [(r["k"], r["a"]) for r in got] == [(3, "z")] and len(got[0]["payload_hash"]) == 64
    for bad in ([(2, "y", 2.5)], [(1, "x", 0.0)], [(4, "p", 1.0), (4, "q", 1.0)]):
        with pytest.raises(lineage.LineageConflict):
            lineage.appended(old, spark.createDataFrame(bad, kind), ["k"])


def test_reach_ends_on_cycles_and_has_least_depths(spark):
    random.seed(2)
    links = [(random.randrange(30), random.randrange(30)) for _ in range(45)] + [(None, 1), (0, 0)]
    e = spark.createDataFrame(links, "s long, t long")
    roots = spark.createDataFrame([(0,), (5,), (5,), (99,), (None,)], "id long")
    for a, b in (("s", "t"), ("t", "s")):
        want = set()
        for root in (0, 5, 99):
            depth, front = {root: 0}, [root]
            while front:
                front = [y for x in front for s, t in links for x_, y in ([(s, t)] if a == "s" else [(t, s)]) if x_ == x and y is not None and y not in depth and not depth.setdefault(y, depth[x] + 1) is None]
            want |= {(root, n, d) for n, d in depth.items()}
        assert set(map(tuple, lineage.reached(e, roots, a, b).collect())) == want
        assert set(map(tuple, lineage.reached(e, roots, a, b, 1).collect())) == {w for w in want if w[2] <= 1}
    near = lineage.reached(e, roots, "s", "t")
    nodes = {r["node"] for r in near.collect()}
    assert sorted(map(tuple, lineage.projected(e, near, "s", "t").collect())) == sorted((s, t) for s, t in links if s in nodes and t in nodes)


def test_quotes_are_found_in_the_raw_text(spark):
    rows = [("a\r\nb．c\rd", "b.c\nd"), ("ab ab", "ab"), ("x\r\n\r\ny z", "\ny z"), ("none", "q"), (None, "q"), ("é\r\n😀。ｆｉｎ", "fin"), ("a", "")]
    d = spark.createDataFrame(rows, "t string, q string")
    got = [r["p"] for r in d.select(relocated("t", "q").alias("p")).collect()]
    assert [tuple(p) if p else None for p in got] == [(3, 8, "b．c\rd"), None, (3, 8, "\r\ny z"), None, None, (5, 8, "ｆｉｎ"), None]
    loose = spark.createDataFrame([("one\r\n two　three ", "twothree"), ("one\r\n two three", "o n e t w"), ("a a", "a")], "t string, q string")
    assert [tuple(r["p"]) if r["p"] else None for r in loose.select(relocated("t", "q", True).alias("p")).collect()] == [(6, 15, "two　three"), (0, 8, "one\r\n tw"), None]


def find_all(text, patterns):
    hits = [(i, -len(p), rank, p, kind) for p, kind, rank in patterns for i in range(len(text)) if text.startswith(p, i)]
    out, free = [], 0
    for start, minus, _, p, kind in sorted(hits):
        if start >= free:
            out.append((start, start - minus, p, kind))
            free = start - minus
    return out


@pytest.mark.parametrize("most", [100, 3])
def test_mentions_equal_a_search_pattern_by_pattern(spark, most):
    random.seed(6)
    texts = [(i, "".join(random.choice("abcé") for _ in range(random.randrange(0, 60)))) for i in range(40)] + [(98, None), (99, "")]
    patterns = [("ab", "x", 0), ("abc", "y", 0), ("bca", "x", 1), ("bca", "z", 0), ("éa", "x", 0), ("cab", "y", 2), ("a", "w", 5), ("", "w", 0)]
    d = spark.createDataFrame(texts, "id long, text string")
    got = mentions.find_mentions(d, spark.createDataFrame(patterns, "pattern string, kind string, priority int"), "id", "text", most)
    want = sorted((i, *m) for i, t in texts if t for m in find_all(t, [(p, k, r) for p, k, r in patterns if p]))
    assert sorted(map(tuple, got.collect())) == want


def test_mentions_compile_to_events_or_reasons(spark):
    chunks = spark.createDataFrame([(1, "c1", "Acme Corp．\r\nsold 20 units to Bolt. Bolt said so."), (2, "c1", "nothing")], "document_id long, chunk_id string, text string")
    taxonomy = spark.createDataFrame([("sale", ["issuer", "buyer"], ["amount"])], "event_type string, roles array<string>, required array<string>")
    allowed = spark.createDataFrame([(1, "Acme", ["issuer"]), (1, "Bolt", ["buyer", "issuer"])], "document_id long, subject string, roles array<string>")
    kind = "document_id long, mention_id string, chunk_id string, event_type string, subject string, role string, quote string, facts array<struct<name:string,raw:string>>"
    rows = [
        (1, "ok", "c1", "sale", "Acme", "issuer", "Corp.\nsold 20 units", [("amount", "20 units")]),
        (1, "type", "c1", "rent", "Acme", "issuer", "sold 20", []),
        (1, "chunk", "c9", "sale", "Acme", "issuer", "sold 20", [("amount", "20")]),
        (1, "twice", "c1", "sale", "Bolt", "buyer", "Bolt", [("amount", "Bolt")]),
        (1, "who", "c1", "sale", "Cord", "buyer", "sold 20", [("amount", "20")]),
        (1, "role", "c1", "sale", "Acme", "buyer", "sold 20", [("amount", "20")]),
        (1, "fact", "c1", "sale", "Acme", "issuer", "sold 20", None),
        (1, "value", "c1", "sale", "Acme", "issuer", "sold 20", [("amount", "21")]),
    ]
    got = {r["mention_id"]: r for r in mentions.compile_mentions(spark.createDataFrame(rows, kind), chunks, taxonomy, allowed).collect()}
    reasons = {k: r["reasons"] for k, r in got.items()}
    assert reasons == {"ok": [], "type": ["mention_event_type_unknown"], "chunk": ["mention_evidence_chunk_missing"], "twice": ["mention_evidence_not_unique"], "who": ["mention_subject_missing"], "role": ["mention_subject_role_invalid"], "fact": ["mention_fact_missing"], "value": ["mention_fact_not_in_quote"]}
    assert got["ok"]["accepted"] and tuple(got["ok"]["place"]) == (5, 25, "Corp．\r\nsold 20 units")


def test_row_group_statistics_answer_without_a_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "date_add(date'2024-01-01', cast(id as int)) as d", "cast(id as string) as s").repartition(3).write.parquet(str(tmp_path / "t"))
    for column, first, last, pushed in (("id", 0, 999, True), ("d", None, None, True), ("s", "0", "999", False)):
        before = spark.conf.get("spark.sql.sources.useV1SourceList")
        got, by_statistics = store.statistics_bounds(spark, str(tmp_path / "t"), column)
        row = got.first()
        assert by_statistics is pushed and row["rows"] == 1000 and (first is None or (row["first"], row["last"]) == (first, last))
        assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
