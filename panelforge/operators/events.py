"""Event detection on a panel, event studies, and event features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.scalar import truth
from panelforge.operators.roll import change, series


#: Columns whose values an event carries as context, where the panel has them.
CONTEXT = ("close", "macd_dif", "macd_dea", "macd_hist", "rsi_14", "adx_14", "volume_ratio_5_20", "flow_net_large", "industry_breadth")
#: Parts of an event's name that say which way it points; the first list that fits counts.
UPWARD = ("up", "golden", "bullish", "rise", "strengthening")
DOWNWARD = ("down", "death", "bearish", "fall", "weakening", "breakdown")


def direction(event: str) -> str:
    return "up" if any(x in event for x in UPWARD) else "down" if any(x in event for x in DOWNWARD) else "neutral"


def volume_price_stage(ret: Column, ratio: Column) -> Column:
    """How price and volume go together; a missing value counts as unchanged."""
    up, down, more, less = truth(ret > 0.005), truth(ret < -0.005), truth(ratio > 1.05), truth(ratio < 0.95)
    flat = ~up & ~down
    return (
        F.when(up & more, "volume_price_rise_confirmed")
        .when(up & less, "volume_price_rise_divergent")
        .when(down & more, "volume_price_fall_confirmed")
        .when(down & less, "volume_price_fall_exhausting")
        .when(flat & more, "volume_expansion_flat_price")
        .when(flat & less, "volume_contraction_flat_price")
        .otherwise("volume_price_neutral")
    )


STAGES = ("volume_contraction_flat_price", "volume_expansion_flat_price", "volume_price_fall_confirmed", "volume_price_fall_exhausting", "volume_price_rise_confirmed", "volume_price_rise_divergent")


def prepared(panel: DataFrame) -> DataFrame:
    """The panel with the day's and five days' changes and the volume-price stage that the masks need; columns it lacks are missing values."""
    for c in (*CONTEXT, "macd_hist_slope", "macd_cross", "sma_5", "sma_20", "bollinger_upper", "bollinger_lower", "bollinger_width"):
        if c not in panel.columns:
            panel = panel.withColumn(c, F.lit(None).cast("double"))
    w = series()
    d = panel.withColumn("__ret", change("close")).withColumn("__ret5", change("close", 5)).withColumn("__dif5", F.col("macd_dif") - F.lag("macd_dif", 5).over(w))
    return d.withColumn("__stage", volume_price_stage(F.col("__ret"), F.col("volume_ratio_5_20")))


def masks() -> dict[str, Column]:
    """Named conditions over rows of prepared(): the day's own and earlier rows of the code; a missing value makes none of them true."""
    w = series()
    x = F.col
    lag = lambda c: F.lag(c).over(w)
    over = lambda a, b: (lag(a) <= lag(b)) & (x(a) > x(b))
    under = lambda a, b: (lag(a) >= lag(b)) & (x(a) < x(b))
    above = lambda a, level: (lag(a) <= level) & (x(a) > level)
    below = lambda a, level: (lag(a) >= level) & (x(a) < level)
    prior, today, before = w.rowsBetween(-20, -1), w.rowsBetween(-59, 0), w.rowsBetween(-60, -1)
    seen = F.count("close").over(prior) >= 3
    narrow = lambda span: F.when(F.count("bollinger_width").over(span) >= 3, F.percentile("bollinger_width", 0.2).over(span))
    out = {
        "macd_golden_cross": truth(x("macd_cross") == 1) | truth(over("macd_dif", "macd_dea")),
        "macd_death_cross": truth(x("macd_cross") == -1) | truth(under("macd_dif", "macd_dea")),
        "macd_zero_cross_up": above("macd_dif", 0),
        "macd_zero_cross_down": below("macd_dif", 0),
        "macd_hist_reversal_up": above("macd_hist_slope", 0),
        "macd_hist_reversal_down": below("macd_hist_slope", 0),
        "macd_hist_sign_up": above("macd_hist", 0),
        "macd_hist_sign_down": below("macd_hist", 0),
        "ma_golden_cross_5_20": over("sma_5", "sma_20"),
        "ma_death_cross_5_20": under("sma_5", "sma_20"),
        "price_breakout_20": seen & (x("close") > F.max("close").over(prior)),
        "price_breakdown_20": seen & (x("close") < F.min("close").over(prior)),
        "rsi_oversold_exit": (lag("rsi_14") < 30) & (x("rsi_14") >= 30),
        "rsi_overbought_exit": (lag("rsi_14") > 70) & (x("rsi_14") <= 70),
        "adx_trend_strengthening": (lag("adx_14") < 25) & (x("adx_14") >= 25),
        "adx_trend_weakening": (lag("adx_14") >= 25) & (x("adx_14") < 25),
        "bollinger_breakout_up": x("close") > x("bollinger_upper"),
        "bollinger_breakout_down": x("close") < x("bollinger_lower"),
        "bollinger_squeeze": (x("bollinger_width") <= narrow(today)) & (lag("bollinger_width") > narrow(before)),
        "macd_bearish_divergence": (x("__ret5") > 0.03) & (x("__dif5") < 0),
        "macd_bullish_divergence": (x("__ret5") < -0.03) & (x("__dif5") > 0),
        "flow_price_confirmation_up": (x("__ret") > 0) & (x("flow_net_large") > 0),
        "flow_price_confirmation_down": (x("__ret") < 0) & (x("flow_net_large") < 0),
        "flow_price_divergence_bearish": (x("__ret") > 0) & (x("flow_net_large") < 0),
        "flow_price_divergence_bullish": (x("__ret") < 0) & (x("flow_net_large") > 0),
        "industry_breadth_reversal_up": (lag("industry_breadth") < 0.4) & (x("industry_breadth") >= 0.5),
        "industry_breadth_reversal_down": (lag("industry_breadth") > 0.6) & (x("industry_breadth") <= 0.5),
    }
    return out | {s: (x("__stage") == s) & (F.coalesce(lag("__stage"), F.lit("")) != s) for s in STAGES}


def detect(panel: DataFrame, market: str, only: tuple[str, ...] | None = None, code: str = "code", date: str = "trade_date") -> DataFrame:
    """A row for each true condition: event_id (20 characters of the SHA-256 of market, code, date and event), event, market, code,
    trade_date, direction, regime, industry and the context as JSON. One pass over the panel, whatever the number of events."""
    context = [c for c in CONTEXT if c in panel.columns]
    wanted = {k: c for k, c in masks().items() if only is None or k in only}
    flags = F.array_compact(F.array(*[F.when(truth(c), F.struct(F.lit(k).alias("event"), F.lit(direction(k)).alias("direction"))) for k, c in wanted.items()]))
    label = lambda c, other: (F.coalesce(F.col(c).cast("string"), F.lit(other)) if c in panel.columns else F.lit(other)).alias(c)
    hit = prepared(panel).withColumn("__e", flags).withColumn("__e", F.explode("__e"))
    own = F.substring_index(F.col(code).cast("string"), ".", 1)
    key = F.concat_ws("|", F.lit(market), own, F.col(date), F.col("__e.event"))
    told = F.to_json(F.struct(*sorted(context))) if context else F.lit("{}")
    return hit.select(F.substring(F.sha2(key, 256), 1, 20).alias("event_id"), "__e.event", F.lit(market).alias("market"), own.alias(code), date, "__e.direction", label("regime", "unknown"), label("industry", "unclassified"), told.alias("context"))


def event_study(events: DataFrame, labels: DataFrame, keys: list[str], least: int, cost: float) -> DataFrame:
    """Statistics of each event and horizon: counts, rates, mean, median, quantiles, excursions, lift over the horizon's baseline, stability."""
    base = labels.groupBy("horizon").agg(F.avg((F.col("label") == "up").cast("int")).alias("base_up"))
    x = F.col("excess")
    stats = events.join(labels, keys).groupBy("event", "horizon").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("label") == "up").cast("int")).alias("up_rate"),
        F.avg((F.col("label") == "down").cast("int")).alias("down_rate"),
        F.avg(x).alias("mean"),
        F.percentile("excess", F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias("__q"),
        F.avg("mfe").alias("mfe"),
        F.avg("mae").alias("mae"),
        F.stddev_samp(x).alias("sd"),
    )
    stats = stats.select("*", *[F.col("__q")[i].alias(n) for i, n in enumerate(("q10", "q25", "median", "q75", "q90"))]).drop("__q")
    width = 2 * 1.96 * F.col("sd") / F.sqrt("n")
    out = stats.join(F.broadcast(base), "horizon")  # a row a horizon
    return out.withColumn("cost_adjusted", F.col("mean") - cost).withColumn("lift", F.col("up_rate") - F.col("base_up")).withColumn("stability", F.least(F.lit(1.0), F.col("n") / least) * F.greatest(F.lit(0.0), 1 - F.least(F.coalesce(width, F.lit(1.0)) / 0.1, F.lit(1.0)))).withColumn("research_only", F.col("n") < least).drop("sd", "base_up")


def bootstrap_interval(df: DataFrame, keys: list[str], value: str, samples: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Bootstrap interval of the mean per key. Groups of over 500 values draw normal means from their sums; smaller ones are resampled. The seed comes from the key.

    Only sums are needed of large groups, so a group of any size is aggregated first; at most 500 values of a key reach Python.
    """
    import numpy as np
    import pandas as pd

    w = W.partitionBy(*keys)
    stats = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    small = df.filter(F.col(value).isNotNull()).join(stats.filter("n <= 500").select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("values"))
    rows = stats.join(small, keys, "left").withColumn("key", F.xxhash64(*keys, F.lit(seed)))
    del w

    def interval(batches):
        for pdf in batches:
            low, high = [], []
            for n, m, sd, vals, key in zip(pdf["n"], pdf["mean"], pdf["sd"], pdf["values"], pdf["key"]):
                rng = np.random.default_rng(key % (1 << 63))
                draws = rng.normal(m, sd / np.sqrt(n), samples) if vals is None else rng.choice(np.asarray(vals), (samples, n)).mean(axis=1)
                a, b = np.quantile(draws, [(1 - level) / 2, (1 + level) / 2])
                low.append(a)
                high.append(b)
            yield pdf[keys + ["n", "mean"]].assign(low=pd.Series(low, dtype=float), high=pd.Series(high, dtype=float))

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", n long, mean double, low double, high double"
    return rows.mapInPandas(interval, kinds)
