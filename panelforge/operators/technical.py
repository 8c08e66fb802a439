"""Technical indicators per code. Moving averages and windows are window expressions; the exponential
and Wilder recursions, which no window frame expresses, run once per code in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.scalar import safe_ratio, truth
from panelforge.operators import roll
from panelforge.operators.roll import CODE, DATE, change, last_n, mean, median, over_series, rolling_corr, rolling_percentile, series, since, so_far, std, total


def trend(df: DataFrame) -> DataFrame:
    """Simple averages of 5, 10, 20, 60 and 120 rows and the close's distance to them."""
    for n in (5, 10, 20, 60, 120):
        df = df.withColumn(f"sma_{n}", mean("close", n)).withColumn(f"sma_{n}_distance", safe_ratio("close", f"sma_{n}") - 1)
    return df


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Bands of k population deviations, the close's place between them, and their width."""
    sd = roll.rolling(F.stddev_pop, "close", n)
    df = df.withColumn("__m", mean("close", n)).withColumn("__s", sd).withColumn("bollinger_upper", F.col("__m") + k * F.col("__s")).withColumn("bollinger_lower", F.col("__m") - k * F.col("__s"))
    width = F.col("bollinger_upper") - F.col("bollinger_lower")
    return df.withColumn("bollinger_position", F.when(width != 0, (F.col("close") - F.col("bollinger_lower")) / width)).withColumn("bollinger_width", safe_ratio(width, "__m")).drop("__m", "__s")


def momentum(df: DataFrame) -> DataFrame:
    df = df.withColumn("return_1", change("close"))
    for n in (5, 10, 20, 60, 120):
        df = df.withColumn(f"momentum_{n}", change("close", n))
    return df.withColumn("reversal_5", -F.col("momentum_5"))


def volatility(df: DataFrame, year: int = 252) -> DataFrame:
    """Realised volatility of 5, 20 and 60 returns; downside volatility takes positive returns as 0."""
    for n in (5, 20, 60):
        df = df.withColumn(f"volatility_{n}", std("return_1", n) * year**0.5)
    down = F.when(F.col("return_1").isNotNull(), F.least(F.col("return_1"), F.lit(0.0)))
    return df.withColumn("downside_volatility_20", std(down, 20) * year**0.5)


def price_action(df: DataFrame) -> DataFrame:
    """Slope, gap, intraday range, close location, drawdown of 60 and breakout over the 20 highs before today."""
    w = series()
    spread = F.col("high") - F.col("low")
    prior = w.rowsBetween(-20, -1)
    return (
        df.withColumn("price_slope_20", change("close", 20) / 20)
        .withColumn("gap_return", safe_ratio("open", F.lag("close").over(w)) - 1)
        .withColumn("intraday_range", safe_ratio(spread, "close"))
        .withColumn("close_location", F.when(spread != 0, (F.col("close") - F.col("low")) / spread))
        .withColumn("drawdown_60", F.col("close") / roll.rolling(F.max, "close", 60) - 1)
        .withColumn("breakout_20", F.when(F.count("high").over(prior) >= 20, truth(F.col("close") > F.max("high").over(prior)).cast("int")))
    )


def relative_strength(df: DataFrame, benchmark: str, n: int = 20) -> DataFrame:
    return df.withColumn(f"relative_strength_{n}", change("close", n) - change(benchmark, n))


def volume(df: DataFrame) -> DataFrame:
    """Volume ratio and z, on-balance and accumulation flow of 5 rows over their volume, money flow index of 14."""
    w = series()
    step = F.signum(F.col("close") - F.lag("close").over(w))
    spread = F.col("high") - F.col("low")
    ad = F.when(spread != 0, (2 * F.col("close") - F.col("low") - F.col("high")) / spread * F.col("volume")).otherwise(0.0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumn("volume_ratio_5_20", safe_ratio(mean("volume", 5), mean("volume", 20))).withColumn("volume_z_20", safe_ratio(F.col("volume") - mean("volume", 20), std("volume", 20)))
    df = df.withColumn("__obv", F.sum(F.coalesce(step * F.col("volume"), F.lit(0.0))).over(so_far())).withColumn("__ad", F.sum(ad).over(so_far())).withColumn("__tp", typical)
    five = total("volume", 5)
    df = df.withColumn("obv_flow_5", safe_ratio(F.col("__obv") - F.lag("__obv", 5).over(w), five)).withColumn("ad_flow_5", safe_ratio(F.col("__ad") - F.lag("__ad", 5).over(w), five))
    df = df.withColumn("__up", F.when(F.lag("__tp").over(w).isNotNull(), F.when(F.col("__tp") > F.lag("__tp").over(w), F.col("__tp") * F.col("volume")).otherwise(0.0)))
    df = df.withColumn("__down", F.when(F.lag("__tp").over(w).isNotNull(), F.when(F.col("__tp") < F.lag("__tp").over(w), F.col("__tp") * F.col("volume")).otherwise(0.0)))
    return df.withColumn("mfi_14", 100 * safe_ratio(total("__up", 14), total("__up", 14) + total("__down", 14))).drop("__obv", "__ad", "__tp", "__up", "__down")


def liquidity(df: DataFrame) -> DataFrame:
    """Amount ratio and z, Amihud illiquidity against the 60-row median amount, price-volume confirmation and correlation, up-volume share."""
    df = df.withColumn("amount_ratio_5_20", safe_ratio(mean("amount", 5), mean("amount", 20))).withColumn("amount_z_20", safe_ratio(F.col("amount") - mean("amount", 20), std("amount", 20)))
    df = df.withColumn("__ill", safe_ratio(F.abs("return_1"), safe_ratio("amount", median("amount", 60, 20)))).withColumn("amihud_20", mean("__ill", 20))
    df = df.withColumn("price_volume_confirmation", F.signum("return_1") * F.signum(F.col("volume_ratio_5_20") - 1))
    df = df.withColumn("__lv", F.log1p("volume") - F.lag(F.log1p("volume")).over(series())).withColumn("volume_price_corr_20", rolling_corr("return_1", "__lv", 20))
    up = F.when(F.col("return_1").isNotNull(), F.when(F.col("return_1") > 0, F.col("volume")).otherwise(0.0))
    return df.withColumn("up_volume_ratio_20", safe_ratio(total(up, 20), total("volume", 20))).drop("__ill", "__lv")


def turnover(df: DataFrame, rate: str = "turnover_rate") -> DataFrame:
    return df.withColumn("turnover_percentile_60", rolling_percentile(rate, 60, 20)).withColumn("turnover_change_5", change(rate, 5)).withColumn("turnover_change_20", change(rate, 20))


def ema(x: np.ndarray, n: int, start: int | None = None) -> np.ndarray:
    """Exponential average seeded with the mean of n values that end at index `start` (n - 1 by default)."""
    out = np.full(len(x), np.nan)
    first = n - 1 if start is None else start
    if len(x) > first:
        k, v = 2.0 / (n + 1), x[first - n + 1 : first + 1].mean()
        tail = [v := float(v)]
        for y in x[first + 1 :].tolist():
            v += k * (y - v)
            tail.append(v)
        out[first:] = tail
    return out


def wilder(x: np.ndarray, n: int, first: int, mean_seed: bool = True) -> np.ndarray:
    """Wilder smoothing; seeded at index first + n - 1 with the mean (or, for directional movement, the sum) of n values."""
    out = np.full(len(x), np.nan)
    at = first + n - 1
    if len(x) > at:
        v = x[first : at + 1].mean() if mean_seed else x[first : at + 1].sum()
        tail = [v := float(v)]
        for y in x[at + 1 :].tolist():
            v = (v * (n - 1) + y) / n if mean_seed else v - v / n + y
            tail.append(v)
        out[at:] = tail
    return out


RECURSIVE = ("ema_12", "ema_26", "macd_dif", "macd_dea", "macd_hist", "rsi_14", "adx_14", "atr_14", "natr_14")


def recursive_of(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> dict[str, np.ndarray]:
    """EMA, MACD, RSI, ADX and ATR of one code's rows in order."""
    n = len(close)
    out = {"ema_12": ema(close, 12), "ema_26": ema(close, 26)}
    dif = ema(close, 12, 25) - out["ema_26"]  # both averages begin at index 25
    dea = np.full(n, np.nan)
    if n > 25:
        dea[25:] = ema(dif[25:], 9)
    dif = np.where(np.isnan(dea), np.nan, dif)
    out |= {"macd_dif": dif, "macd_dea": dea, "macd_hist": dif - dea}
    step = np.diff(close, prepend=np.nan)
    up, down = wilder(np.maximum(step, 0), 14, 1), wilder(np.maximum(-step, 0), 14, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out["rsi_14"] = np.where(np.isnan(up), np.nan, np.where(up + down == 0, 0.0, 100 * up / (up + down)))
        before = np.r_[np.nan, close[:-1]]
        tr = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
        out["atr_14"] = wilder(tr, 14, 1)
        out["natr_14"] = 100 * out["atr_14"] / close
        rise, fall = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
        plus, minus = np.where((rise > fall) & (rise > 0), rise, 0.0), np.where((fall > rise) & (fall > 0), fall, 0.0)
        # directional movement is seeded with the sum of 13 values, then decayed by a fourteenth
        sums = []
        for x in (plus, minus, tr):
            s = np.full(n, np.nan)
            if n > 13:
                tail = [v := float(x[1:14].sum())]
                for y in x[14:].tolist():
                    v = v - v / 14 + y
                    tail.append(v)
                s[13:] = tail
            sums.append(s)
        di_p, di_m = 100 * sums[0] / sums[2], 100 * sums[1] / sums[2]
        dx = np.where(di_p + di_m == 0, 0.0, 100 * np.abs(di_p - di_m) / (di_p + di_m))
        out["adx_14"] = wilder(dx, 14, 14)
    return out


def recursive(df: DataFrame, code: str = CODE, date: str = DATE) -> DataFrame:
    """df with the RECURSIVE columns. Rows with a missing price are left out of the recursion and get null.

    One code a group (a code's history is bounded by its sessions). Where all columns are text and doubles the group carries them
    and nothing is joined; otherwise it gets the columns that it needs and its results are joined by code and date.
    """
    plain = all(f.dataType.simpleString() in ("string", "double") for f in df.schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        x = pdf[["high", "low", "close"]].to_numpy(float)
        ok = ~np.isnan(x).any(axis=1)
        found = recursive_of(*np.ascontiguousarray(x[ok].T))
        columns = {}
        for c in RECURSIVE:
            columns[c] = np.full(len(pdf), np.nan)
            columns[c][ok] = found[c]
        return pdf.assign(**columns)

    own = df if plain else df.select(code, date, *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", " + ", ".join(f"{c} double" for c in RECURSIVE)
    found = own.groupBy(code).applyInPandas(run, kinds)
    doubles = [f.name for f in own.schema if f.dataType.simpleString() == "double"]
    found = found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in (*doubles, *RECURSIVE)})
    return found if plain else df.join(found.select(code, date, *RECURSIVE), [code, date], "left")


def macd_state(df: DataFrame) -> DataFrame:
    """Crosses (+1, -1), slope, acceleration, zero state and age of the last cross."""
    w = series()
    before = F.lag("macd_hist").over(w)
    df = df.withColumn("macd_cross", F.when(truth((F.col("macd_hist") > 0) & (before <= 0)), 1).when(truth((F.col("macd_hist") < 0) & (before >= 0)), -1).otherwise(0))
    df = df.withColumn("macd_hist_slope", F.col("macd_hist") - before)
    df = df.withColumn("macd_hist_acceleration", F.col("macd_hist_slope") - F.lag("macd_hist_slope").over(w))
    return df.withColumn("macd_zero_state", F.signum("macd_dif")).withColumn("macd_cross_age", since(F.col("macd_cross") != 0))


def ewm(df: DataFrame, x: str, alpha: float, out: str, code: str = CODE, date: str = DATE) -> DataFrame:
    """Unseeded exponential average of the values so far, the first value as start; a missing value leaves it as it was."""

    def average(values: np.ndarray) -> np.ndarray:
        got, v = np.full(len(values), np.nan), np.nan
        for i, y in enumerate(values.tolist()):
            v = y if v != v else v if y != y else v + alpha * (y - v)
            got[i] = v
        return got

    return over_series(df, [code], date, x, out, average)


__all__ = ["trend", "bollinger", "momentum", "volatility", "price_action", "relative_strength", "volume", "liquidity", "turnover", "recursive", "macd_state", "ewm", "last_n"]
