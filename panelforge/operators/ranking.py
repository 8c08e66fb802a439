"""Ranking models: boosted histogram trees on pairwise gradients of each date.

A round has one pass that makes gradients (a date's rows by distinct bins, scores and relevances, not by pairs) and one a level of the tree that adds them up by node,
feature and bin where the rows lie; what reaches the driver is a number of sums a node, feature and bin. Scores are expressions
of the binned features, so the plan of a round does not grow with the rounds before it beyond the expression of its trees.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Scores of a date that are met with all others at once.
BLOCK = 512


def lambdas(score: np.ndarray, relevance: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, curvature) of the pairwise logistic loss, each pair weighted by what swapping it changes in NDCG; rows of one date. Ties in score are placed by row.

    A row may stand for `count` equal ones and gets the sums of theirs. Pairs are met by distinct score and relevance: all rows of a higher score are placed before all
    of a lower one, so distances of places add up from counts and sums, those within a score from running ones.
    """
    m = np.ones(len(score)) if count is None else np.asarray(count, float)
    order = np.argsort(-score, kind="stable")
    end = np.cumsum(m[order])
    table = np.concatenate([[0.0], np.cumsum(1 / np.log2(np.arange(int(m.sum())) + 2.0))])
    d = np.empty(len(score))  # sums of the discounts of a row's places
    d[order] = table[end.astype(np.int64)] - table[(end - m[order]).astype(np.int64)]
    scores, s = np.unique(score, return_inverse=True)
    levels, r = np.unique(relevance, return_inverse=True)
    gain = 2.0**levels - 1
    many = np.cumsum(np.bincount(r, m, len(levels))[::-1]).astype(np.int64)
    ideal = float(gain[::-1] @ (table[many] - table[np.concatenate([[0], many[:-1]])])) if len(score) else 0.0
    g, h = np.zeros(len(score)), np.zeros(len(score))
    if ideal <= 0:
        return g, h
    apart = np.abs(gain[:, None] - gain[None, :]) / ideal
    lower, upper = np.triu(apart, 1), np.tril(apart, -1)  # at [other, own]: the other's relevance is below, above
    cell = s * len(levels) + r
    sums = [np.bincount(cell, x, len(scores) * len(levels)).reshape(len(scores), -1) for x in (m, d)]
    below, above = [x @ lower for x in sums], [x @ upper for x in sums]
    slopes = [np.empty((len(scores), len(levels))) for _ in range(4)]
    for a in range(0, len(scores), BLOCK):
        i = slice(a, a + BLOCK)
        gap = np.clip(scores[i, None] - scores[None, :], -60, 60)
        rho, side = 1 / (1 + np.exp(gap)), np.sign(scores[i, None] - scores[None, :])
        back, curve = side / (1 + np.exp(-gap)), side * rho * (1 - rho)
        rho *= side
        for k in (0, 1):
            slopes[k][i] = rho @ below[k] - back @ above[k]
            slopes[2 + k][i] = curve @ (below[k] + above[k])
    g += d * slopes[0][s, r] - m * slopes[1][s, r]
    h += d * slopes[2][s, r] - m * slopes[3][s, r]
    first = np.searchsorted(-score[order], -score[order])  # of equal scores, and what follows the last
    last = np.searchsorted(-score[order], -score[order], side="right")
    for k in range(len(levels)):
        own = (r == k)[order]
        run = [np.concatenate([[0.0], np.cumsum(np.where(own, x[order], 0.0))]) for x in (m, d)]
        at = np.arange(len(order))
        (n0, d0), (n1, d1) = ((x[at] - x[first] for x in run), (x[last] - x[at + 1] for x in run))
        far = np.empty(len(score))
        far[order] = m[order] * d0 - n0 * d[order] + n1 * d[order] - m[order] * d1
        g += 0.5 * far * (lower[k] - upper[k])[r]
        h += 0.25 * far * apart[k][r]
    return g, h


def bins(df: DataFrame, features: list[str], train: Column, count: int) -> dict[str, list[float]]:
    """Upper edges of each feature's bins: quantiles of its training values, found by sketches."""
    cuts = [k / count for k in range(1, count)]
    row = df.filter(train).agg(*[F.percentile_approx(F.col(f).cast("double"), cuts, 10_000).alias(f) for f in features]).first()
    return {f: sorted({float(x) for x in row[f] or [] if x is not None}) for f in features}


def binned(value: Column, edges: list[float]) -> Column:
    """Bin of a value: how many edges lie below it; missing values are bin 0."""
    return reduce(lambda a, e: a + F.coalesce((value > e).cast("int"), F.lit(0)), edges, F.lit(0))


def tree_value(tree: list | float, bin_of: dict[str, Column]) -> Column:
    """Value of a tree [feature, bin, left, right]: left where the feature's bin is at most `bin`."""
    if not isinstance(tree, list):
        return F.lit(float(tree))
    feature, at, left, right = tree
    return F.when(bin_of[feature] <= at, tree_value(left, bin_of)).otherwise(tree_value(right, bin_of))


def _node(tree: list | int, bin_of: dict[str, Column]) -> Column:
    if not isinstance(tree, list):
        return F.lit(int(tree))
    feature, at, left, right = tree
    return F.when(bin_of[feature] <= at, _node(left, bin_of)).otherwise(_node(right, bin_of))


def histograms(rows: DataFrame, features: list[str], count: int) -> DataFrame:
    """(node, feature, bin, g, h, n) sums of rows of (node, g, h, bins): added up in each batch, then by Spark. A column n says how many rows one stands for."""

    def run(batches):
        for pdf in batches:
            node = pdf["node"].to_numpy()
            out = []
            for k, f in enumerate(features):
                cell = node.astype(np.int64) * count + pdf[f].to_numpy()
                size = int(cell.max()) + 1 if len(cell) else 0
                n = np.bincount(cell, minlength=size)
                at = np.flatnonzero(n)
                n = np.bincount(cell, pdf["n"], size).astype(np.int64) if "n" in pdf else n
                out.append(pd.DataFrame({"node": at // count, "feature": k, "bin": at % count, "g": np.bincount(cell, pdf["g"], size)[at], "h": np.bincount(cell, pdf["h"], size)[at], "n": n[at]}))
            yield pd.concat(out)

    sums = rows.mapInPandas(run, "node int, feature int, bin int, g double, h double, n long")
    return sums.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, penalty: float, least: int) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best cut of sums by (feature, bin); None without gain. Ties go to the first feature and bin."""
    gl, hl, nl = (np.cumsum(x, axis=1)[:, :-1] for x in (g, h, n))
    gt, ht, nt = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True), n.sum(axis=1, keepdims=True)
    gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
    gain = np.where((nl >= least) & (nt - nl >= least), gain, -np.inf)
    if not gain.size or not gain.max() > 1e-12:
        return None
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def fit_ranker(df: DataFrame, train: Column, features: list[str], relevance: str, date: str = "trade_date", trees: int = 10, depth: int = 3, rate: float = 0.1, penalty: float = 1.0, count: int = 32, least: int = 20) -> tuple[dict[str, list[float]], list]:
    """(edges, trees) of a boosted ranker; relevance: whole numbers from 0, a date's rows are ranked against each other.

    Rows of a date that share relevance and bins are one row with their number, so a date is a group of at most as many rows as there are such cells. Rows with a
    missing relevance are left out. df is read twice.
    """
    edges = bins(df, features, train, count)
    cells = df.filter(train & F.col(relevance).isNotNull()).select(F.col(date).alias("__date"), F.col(relevance).cast("double").alias("__rel"), *[binned(F.col(f), edges[f]).cast("int").alias(f) for f in features])
    base = cells.groupBy("__date", "__rel", *features).agg(F.count(F.lit(1)).alias("__n")).repartition("__date").persist()
    bin_of = {f: F.col(f) for f in features}
    kinds = ", ".join(f"`{f}` int" for f in features)

    def gradients(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(pdf.columns)).reset_index(drop=True)
        g, h = lambdas(pdf["__score"].to_numpy(), pdf["__rel"].to_numpy(), pdf["__n"].to_numpy())
        return pdf[features].assign(g=g, h=h, n=pdf["__n"])

    model: list = []
    for _ in range(trees):
        rows = base.withColumn("__score", score_of(model, bin_of)).groupBy("__date").applyInPandas(gradients, f"{kinds}, g double, h double, n long").persist()
        tree: list | int = 0
        leaves, values = {0: None}, {}
        for level in range(depth + 1):
            cells = histograms(rows.withColumn("node", _node(tree, bin_of)), features, count).collect()
            sums: dict[int, np.ndarray] = {}
            for r in cells:
                sums.setdefault(r["node"], np.zeros((3, len(features), count)))[:, r["feature"], r["bin"]] = r["g"], r["h"], r["n"]
            splits = {}
            for node in leaves:
                g, h, n = sums.get(node, np.zeros((3, len(features), count)))
                values[node] = rate * g[0].sum() / (h[0].sum() + penalty) if len(features) else 0.0
                if level < depth and (found := best_split(g, h, n, penalty, least)):
                    splits[node] = found
            if not splits:
                break
            grow = lambda t: [t[0], t[1], grow(t[2]), grow(t[3])] if isinstance(t, list) else [features[splits[t][1]], splits[t][2], 2 * t + 1, 2 * t + 2] if t in splits else t  # noqa: B023, E731
            tree = grow(tree)
            leaves = {c: None for t in splits for c in (2 * t + 1, 2 * t + 2)}
        valued = lambda t: [t[0], t[1], valued(t[2]), valued(t[3])] if isinstance(t, list) else values[t]  # noqa: B023, E731
        model.append(valued(tree))
        rows.unpersist()
    base.unpersist()
    return edges, model


def score_of(model: list, bin_of: dict[str, Column]) -> Column:
    return reduce(lambda a, t: a + tree_value(t, bin_of), model, F.lit(0.0))


def ranked_scores(df: DataFrame, fitted: tuple[dict[str, list[float]], list], out: str = "score") -> DataFrame:
    """df with the score of a fitted ranker."""
    edges, model = fitted
    d = df.withColumns({f"__b_{f}": binned(F.col(f), e) for f, e in edges.items()})
    return d.withColumn(out, score_of(model, {f: F.col(f"__b_{f}") for f in edges})).drop(*[f"__b_{f}" for f in edges])


def ndcg(df: DataFrame, score: str, relevance: str, date: str, tie: str, most: int = 10) -> DataFrame:
    """(date, ndcg) over the first `most` places; dates without any relevance have none."""
    gain = F.pow(F.lit(2.0), F.col(relevance)) - 1
    w = W.partitionBy(date)
    d = df.filter(F.col(relevance).isNotNull()).withColumn("__p", F.row_number().over(w.orderBy(F.col(score).desc(), tie))).withColumn("__q", F.row_number().over(w.orderBy(F.col(relevance).desc(), tie)))
    at = lambda p: F.sum(F.when(F.col(p) <= most, gain / F.log2(F.col(p) + 1.0)))
    return d.groupBy(date).agg(at("__p").alias("__a"), at("__q").alias("__b")).filter("__b > 0").select(date, (F.col("__a") / F.col("__b")).alias("ndcg"))
