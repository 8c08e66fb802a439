"""Calibration of scores: temperature by Newton steps, isotonic fits by pooling that partitions share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.sources.store import held


def softmax(logits: list[Column]) -> list[Column]:
    """Probabilities of logits, without overflow."""
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    parts = [F.exp(x - top) for x in logits]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def temperature(df: DataFrame, logits: list[str], label: str, rounds: int = 50, least: float = 1e-3) -> float:
    """The temperature that makes softmax(logits / T) most likely; label: position of the true class.

    Newton steps on 1 / T, whose loss is convex: two sums of all rows a step reach the driver. Rows with a missing logit or label do not
    count; 1 without rows or where the logits of all rows are equal.
    """
    z = [F.col(c).cast("double") for c in logits]
    ok = F.col(label).isNotNull()
    for c in z:
        ok = ok & c.isNotNull()
    d = df.filter(ok).select(*[c.alias(f"z{i}") for i, c in enumerate(z)], F.col(label).cast("int").alias("y")).persist()
    z = [F.col(f"z{i}") for i in range(len(logits))]
    true = F.get(F.array(*z), F.col("y"))
    beta = 1.0
    for _ in range(rounds):
        p = softmax([c * beta for c in z])
        mean = sum((q * c for q, c in zip(p[1:], z[1:])), p[0] * z[0])
        square = sum((q * c * c for q, c in zip(p[1:], z[1:])), p[0] * z[0] * z[0])
        g, h = d.agg(F.sum(mean - true), F.sum(square - mean * mean)).first()
        if not h or h < 1e-12:
            break
        step = g / h
        new = max(beta - step, beta / 4, least) if step > 0 else min(beta - step, beta * 4)
        done, beta = abs(new - beta) < 1e-12 * max(1.0, beta), new
        if done:
            break
    d.unpersist()
    return 1 / beta


def pooled(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks (low, high, weight, total) in order of low, neighbours pooled until their means rise."""
    level: list[list] = []
    for pdf in rows:
        for low, high, w, t in zip(pdf["low"].tolist(), pdf["high"].tolist(), pdf["weight"].tolist(), pdf["total"].tolist()):
            level.append([low, high, w, t])
            while len(level) > 1 and level[-2][3] * level[-1][2] >= level[-1][3] * level[-2][2]:
                _, high_, w_, t_ = level.pop()
                level[-1][1], level[-1][2], level[-1][3] = high_, level[-1][2] + w_, level[-1][3] + t_
    yield pd.DataFrame(level, columns=["low", "high", "weight", "total"])


def isotonic(df: DataFrame, score: str, value: str, weight: str | None = None) -> DataFrame:
    """(low, high, weight, fitted): the least-squares fit of value that never falls with score, as blocks of scores of one fitted value.

    Pooling adjacent violators may start anywhere: ranges of scores are pooled by themselves, their blocks are dealt to half as many ranges and
    pooled again, until no two neighbouring ranges violate the order. Rows are added up by score first, so ties share a value. What
    a task keeps is the blocks of its range. Rows with a missing score or value do not count; equal neighbouring values are one block.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    s, v = F.col(score).cast("double"), F.col(value).cast("double")
    rows = df.filter(s.isNotNull() & ~F.isnan(s) & v.isNotNull() & ~F.isnan(v) & (w > 0)).groupBy(s.alias("low")).agg(F.sum(w).alias("weight"), F.sum(w * v).alias("total"))
    blocks = rows.select("low", F.col("low").alias("high"), "weight", "total")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        ranges = blocks.repartitionByRange(parts, "low").sortWithinPartitions("low").mapInPandas(pooled, "low double, high double, weight double, total double")
        blocks = held(ranges.withColumn("part", F.spark_partition_id()), "isotonic")
        ends = blocks.groupBy("part").agg(F.min("low").alias("low"), F.min_by(F.struct("weight", "total"), "low").alias("first"), F.max_by(F.struct("weight", "total"), "low").alias("last")).orderBy("low").collect()  # a row a range
        fits = all(a["last"]["total"] * b["first"]["weight"] < b["first"]["total"] * a["last"]["weight"] for a, b in zip(ends, ends[1:]))
        blocks = blocks.drop("part")
        if fits or parts == 1:
            return blocks.select("low", "high", "weight", (F.col("total") / F.col("weight")).alias("fitted"))
        parts = max(1, parts // 2)


def fitted_value(df: DataFrame, blocks: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
    """df with the fitted value of the block a score lies in or after; before the first block its value. Blocks are sorted into one array of steps, few for noisy data."""
    steps = blocks.agg(F.array_sort(F.collect_list(F.struct("low", "fitted"))).alias("__steps"))
    d = df.crossJoin(steps)  # one row
    below = F.filter("__steps", lambda x: x["low"] <= F.col(score).cast("double"))
    value = F.when(F.size(below) > 0, F.element_at(below, F.greatest(F.size(below), F.lit(1)))["fitted"]).otherwise(F.get(F.col("__steps"), F.lit(0))["fitted"])
    return d.withColumn(out, F.when(F.col(score).isNotNull(), value)).drop("__steps")


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Fitted values of given points by the same pooling, for small arrays."""
    points = pd.DataFrame({"low": np.arange(len(values), dtype=float), "high": np.arange(len(values), dtype=float), "weight": weights, "total": np.asarray(values) * weights})
    blocks = next(pooled(iter([points])))
    return np.repeat((blocks["total"] / blocks["weight"]).to_numpy(), (blocks["high"] - blocks["low"] + 1).astype(int)) if len(blocks) else np.zeros(0)
