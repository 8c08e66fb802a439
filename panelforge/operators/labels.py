"""Forward labels: next-session entry, exit h sessions on, benchmark over the same dates, limits, excursions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.scalar import truth

HORIZONS = (3, 5, 10, 20)


def forward_labels(prices: DataFrame, benchmark: DataFrame | None, horizons: tuple[int, ...] = HORIZONS, cost: float = 0.002, label_end: str | None = None, code: str = "code", date: str = "trade_date") -> DataFrame:
    """One row a code, date and horizon with a full window ahead.

    Entry is the next session's open, exit the close h sessions on. excess = return minus the benchmark's
    from the entry date's open to the exit date's close. threshold = max(cost, 0.25 x sigma20 x sqrt(h)), sigma20 of
    daily returns (5 values at least, else 0). label: up, down or flat. Excursions come from the highs and lows of
    sessions 1..h, at least 0 and at most 0. The benchmark is one row a date and is broadcast, so labels, a row a
    horizon, are not moved.
    """
    w = W.partitionBy(code).orderBy(date)
    ret = F.col("close") / F.lag("close").over(w) - 1
    d = prices.withColumn("__r", ret)
    over = w.rowsBetween(-19, 0)
    d = d.withColumn("sigma", F.when(F.count("__r").over(over) >= 5, F.coalesce(F.stddev_samp("__r").over(over), F.lit(0.0))).otherwise(0.0))
    d = d.withColumn("entry_date", F.lead(date, 1).over(w)).withColumn("entry", F.lead("open", 1).over(w)).withColumn("entry_high", F.lead("high", 1).over(w)).withColumn("entry_low", F.lead("low", 1).over(w))
    parts = []
    for h in horizons:
        ahead = w.rowsBetween(1, h)
        whole = F.count(F.lit(1)).over(ahead) == h
        parts.append(F.struct(F.lit(h).alias("horizon"), F.lead(date, h).over(w).alias("exit_date"), F.lead("close", h).over(w).alias("exit"), F.when(whole, F.max("high").over(ahead)).alias("top"), F.when(whole, F.min("low").over(ahead)).alias("bottom")))
    d = d.withColumn("__h", F.array(*parts)).select(code, date, "close", "sigma", "entry_date", "entry", "entry_high", "entry_low", F.explode("__h").alias("h")).select("*", "h.*").drop("h")
    d = d.filter(F.col("exit").isNotNull() & F.col("entry").isNotNull() & (F.col("entry") > 0))
    if label_end is not None:
        d = d.filter(F.col("exit_date") <= label_end)
    d = d.withColumn("ret", F.col("exit") / F.col("entry") - 1)
    if benchmark is not None:
        a = benchmark.select(F.col(date).alias("entry_date"), F.col("open").alias("__bo"))
        b = benchmark.select(F.col(date).alias("exit_date"), F.col("close").alias("__bc"))
        d = d.join(F.broadcast(a), "entry_date").join(F.broadcast(b), "exit_date").withColumn("benchmark_ret", F.col("__bc") / F.col("__bo") - 1).drop("__bo", "__bc")
    else:
        d = d.withColumn("benchmark_ret", F.lit(0.0))
    d = d.withColumn("excess", F.col("ret") - F.col("benchmark_ret")).withColumn("threshold", F.greatest(F.lit(cost), 0.25 * F.col("sigma") * F.sqrt("horizon")))
    label = F.when(truth(F.col("excess") > F.col("threshold")), "up").when(truth(F.col("excess") < -F.col("threshold")), "down").otherwise("flat")
    limit = truth(F.col("entry_high") == F.col("entry_low"))
    move = F.col("entry") / F.col("close") - 1
    return (
        d.withColumn("label", label)
        .withColumn("limit_up", (limit & truth(move >= 0.095)).cast("int"))
        .withColumn("limit_down", (limit & truth(move <= -0.095)).cast("int"))
        .withColumn("mfe", F.greatest(F.col("top") / F.col("entry") - 1, F.lit(0.0)))
        .withColumn("mae", F.least(F.col("bottom") / F.col("entry") - 1, F.lit(0.0)))
        .select(code, date, "horizon", "entry_date", "exit_date", "ret", "benchmark_ret", "excess", "threshold", "label", "limit_up", "limit_down", "mfe", "mae")
    )


def avoidance(labels: DataFrame) -> DataFrame:
    """The short side's view: excess and excursions change sign."""
    return labels.withColumns({"excess": -F.col("excess"), "ret": -F.col("ret"), "mfe": -F.col("mae"), "mae": -F.col("mfe")})
