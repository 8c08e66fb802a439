"""Named strategies, selection controls, regime policy, and the cost-aware move from a held book to an aimed one."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.scalar import mean_of_available, truth
from panelforge.operators.xsec import pct_rank

#: Weights of the rule strategies over the components that rule_components names.
RULES: dict[str, dict[str, float]] = {
    "A_MOM_01": {"momentum_60": 0.60, "momentum_120": 0.40},
    "A_MOM_02": {"momentum_20": 0.20, "momentum_60": 0.40, "momentum_120": 0.40},
    "A_QMLV_01": {"slow_momentum": 0.45, "quality": 0.35, "low_volatility": 0.20},
    "A_QMLV_02": {"slow_momentum": 0.35, "quality": 0.30, "value": 0.20, "low_volatility": 0.15},
    "A_REGIME_01": {"momentum_60": 0.60, "momentum_120": 0.40},
    "A_REGIME_02": {"slow_momentum": 0.45, "quality": 0.35, "low_volatility": 0.20},
    "Q_TREND_01": {"trend": 1.0},
    "Q_TREND_02": {"long_trend": 1.0},
    "Q_DUAL_01": {"slow_momentum": 1.0},
    "Q_DUAL_02": {"slow_momentum": 0.80, "low_volatility": 0.20},
    "Q_TRACK_01": {"trend": 0.70, "product_quality": 0.20, "liquidity": 0.10},
    "Q_TRACK_02": {"long_trend": 0.70, "product_quality": 0.20, "liquidity": 0.10},
}


def rule_components(date: str = "trade_date") -> dict[str, Column]:
    """Components of the rule strategies: percentile ranks of a date, and means of those that are there."""
    high = lambda c: pct_rank(c, [date])
    low = lambda c: 1 - pct_rank(c, [date])
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    out = {f"momentum_{n}": high(f"momentum_{n}") for n in (20, 60, 120)}
    out["slow_momentum"] = mean_of_available(out["momentum_60"], out["momentum_120"])
    out["quality"], out["low_volatility"], out["liquidity"] = F.col("quality"), F.col("low_volatility"), F.col("liquidity")
    out["value"] = mean_of_available(low(positive("pe_ttm")), low(positive("pb")))
    out["trend"] = mean_of_available(out["momentum_60"], out["momentum_120"], high("sma_distance_200"))
    out["long_trend"] = mean_of_available(out["momentum_120"], high("sma_distance_200"))
    out["product_quality"] = mean_of_available(low(F.abs("discount_premium")), low("tracking_error_20"))
    return out


def rule_strategies(panel: DataFrame, specs: list[str], exposure_cap: float | None = None, date: str = "trade_date") -> DataFrame:
    """A row for each row of the panel and rule strategy: spec, score (weighted mean of the components that are there), available_factor_count,
    eligible and risky_exposure. Components and votes are computed once, whatever the number of strategies.

    Trend and track strategies vote: each signal that at least half of the date's rows have positive is a vote of the account; one vote is half
    exposure, more is whole, none is none. Dual strategies hold what lies above its long average and are invested where there is any.
    Regime strategies halve the exposure below the benchmark's long average.
    """
    names = sorted({c for s in specs for c in RULES[s]})
    signals = ("momentum_60", "momentum_120", "sma_distance_200")
    w = W.partitionBy(date)
    parts = rule_components(date)
    d = panel.withColumns({f"__{n}": parts[n] for n in names})
    if any(s.startswith(("Q_TREND", "Q_TRACK")) for s in specs):
        d = d.withColumns({f"__v_{c}": (F.avg(truth(F.col(c) > 0).cast("double")).over(w) >= 0.5).cast("int") for c in signals})
    rows = []
    for spec in specs:
        weights = RULES[spec]
        there = sum((F.when(F.col(f"__{n}").isNotNull(), x).otherwise(0.0) for n, x in weights.items()), F.lit(0.0))
        total = sum((F.coalesce(F.col(f"__{n}"), F.lit(0.0)) * x for n, x in weights.items()), F.lit(0.0))
        score = F.when(there > 0, total / there)
        eligible, exposure = score.isNotNull(), F.lit(1.0)
        if spec.startswith(("Q_TREND", "Q_TRACK")):
            votes = sum((F.col(f"__v_{c}") for c in (signals[1:] if spec.endswith("02") else signals)), F.lit(0))
            exposure = F.when(votes == 1, 0.5).when(votes >= 2, 1.0).otherwise(0.0)
        elif spec.startswith("Q_DUAL"):
            eligible = truth(F.col("sma_distance_200") > 0) & score.isNotNull()
            d = d.withColumn(f"__e_{spec}", F.max(eligible.cast("double")).over(w))
            exposure = F.col(f"__e_{spec}")
        elif spec.startswith("A_REGIME"):
            exposure = F.when(F.col("benchmark_close") < F.col("benchmark_sma_200"), 0.5).when(F.col("benchmark_close").isNotNull() & F.col("benchmark_sma_200").isNotNull(), 1.0)
        if exposure_cap is not None and spec.startswith("Q_"):
            exposure = F.least(exposure, F.lit(exposure_cap))
        count = sum((F.col(f"__{n}").isNotNull().cast("int") for n in weights), F.lit(0))
        rows.append(F.struct(F.lit(spec).alias("spec"), score.alias("score"), count.alias("available_factor_count"), eligible.alias("eligible"), exposure.cast("double").alias("risky_exposure")))
    return d.withColumn("__s", F.explode(F.array(*rows))).select(*panel.columns, "__s.*")


def select_with_controls(scored: DataFrame, held: DataFrame, by: list[str], top_n: int, max_industry_weight: float = 1.0, hold_buffer: float = 0.0, max_holding_days: int = 0, unclassified: str = "未分类") -> DataFrame:
    """The rows of a selection with their place and how they were picked.

    Best scores first with at most round(top_n x weight) of an industry (`rank`), skipped ones by rank where that does not fill
    (`refill`), then held names whose rank lies within the buffer (`buffer`), except those held max_holding_days or longer.
    scored: by, date, code, industry, score. held: by, code, last_buy_date (date). Ties go by code. Greedy picking equals ranks
    within the industry, because a cap depends on nothing else.
    """
    cap, buffer = max(1, round(top_n * max_industry_weight + 1e-9)), max(top_n, int(top_n * (1 + hold_buffer)))
    group = [*by, "date"]
    order = [F.col("score").desc(), F.col("code")]
    d = scored.withColumn("industry", F.when(F.trim("industry") != "", F.col("industry")).otherwise(unclassified))
    d = d.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    d = d.withColumn("__over", (F.row_number().over(W.partitionBy(*group, "industry").orderBy(*order)) > cap).cast("int"))
    d = d.withColumn("__n", F.row_number().over(W.partitionBy(*group).orderBy("__over", *order)))
    d = d.join(held.select(*by, "code", F.col("last_buy_date").alias("__bought"), F.lit(True).alias("__held")), [*by, "code"], "left")
    stale = F.lit(False) if not max_holding_days else truth(F.datediff("date", "__bought") >= max_holding_days)
    kept = truth(F.col("__held")) & (F.col("place") <= buffer) & ~stale
    picked = F.when((F.col("__n") <= top_n) & (F.col("__over") == 0), "rank").when(F.col("__n") <= top_n, "refill").when(kept, "buffer")
    return d.withColumn("picked", picked).filter("picked is not null").drop("__over", "__n", "__bought", "__held")


#: By profile and state, the weights of momentum, quality and low risk.
POLICY = {
    "defensive": {"risk_on": (0.10, 0.10, 0.05), "mixed": (0.00, 0.15, 0.10), "risk_off": (-0.15, 0.25, 0.30)},
    "trend": {"risk_on": (0.30, 0.05, 0.00), "mixed": (0.08, 0.08, 0.05), "risk_off": (-0.35, 0.15, 0.25)},
}


def regime_policy(df: DataFrame, by: list[str], state: str, profile: str, momentum: list[str], quality: list[str], risk: list[str]) -> DataFrame:
    """Scores plus the regime's weights times mean ranks of three groups of factors, on the scale of the scores' deviation (a half at least).

    state: a column of risk_on, mixed, risk_off or unknown, which counts as risk_off. Low risk ranks the risk factors downwards.
    A row without any factor of a group gets no adjustment.
    """
    up = mean_of_available(*[pct_rank(c, by) for c in momentum])
    good = mean_of_available(*[pct_rank(c, by) for c in quality])
    calm = mean_of_available(*[pct_rank(-F.col(c), by) for c in risk])
    now = F.when(F.col(state) == "unknown", "risk_off").otherwise(F.col(state))
    weight = lambda i: F.when(now == "risk_on", POLICY[profile]["risk_on"][i]).when(now == "mixed", POLICY[profile]["mixed"][i]).when(now == "risk_off", POLICY[profile]["risk_off"][i])
    score = F.coalesce(F.col("score"), F.lit(0.0))
    d = df.withColumn("base_score_before_regime", score).withColumn("__up", up).withColumn("__good", good).withColumn("__calm", calm)
    scale = F.greatest(F.stddev_pop("base_score_before_regime").over(W.partitionBy(*by)), F.lit(0.5))
    raw = weight(0) * F.col("__up") + weight(1) * F.col("__good") + weight(2) * F.col("__calm")
    d = d.withColumn("regime_score_adjustment", F.coalesce(raw, F.lit(0.0)) * scale)
    return d.withColumn("score", F.col("base_score_before_regime") + F.col("regime_score_adjustment")).drop("__up", "__good", "__calm")


def live_signals(universe: DataFrame, by: list[str], factors: dict[str, tuple[float, int]], hard: Column, relaxed: Column, profile: str, state: str, top_n: int, sentiment: DataFrame | None = None, sentiment_weight: float = 0.0, name: str = "name", industry: str = "industry", momentum: tuple[str, ...] = (), quality: tuple[str, ...] = (), risk: tuple[str, ...] = (), min_coverage: float = 0.5) -> DataFrame:
    """Candidates of each date from the whole universe to the selection: (by, code, industry, rule, coverage, top, base_score, score, pick, selected, warning).

    Names that hold ST are out; rows that pass the hard filters are taken, or where a date has none those that pass the relaxed ones (a warning
    says so); a sector's sentiment (columns by, industry, sentiment; missing is 0) is a factor that is not demeaned by industry; rows below
    the coverage of factors are out; the regime's policy moves the scores, and the best top_n are selected, ties by code.
    """
    from panelforge.operators.pit import filtered_or_relaxed
    from panelforge.operators.xsec import process_factors

    d = universe.filter(~F.upper(F.coalesce(F.col(name), F.lit(""))).contains("ST"))
    d = filtered_or_relaxed(d, by, hard, relaxed)
    if sentiment is not None:
        d = d.join(sentiment.select(*by, industry, F.col("sentiment").alias("sector_sentiment")), [*by, industry], "left").fillna(0.0, ["sector_sentiment"])
        factors = factors | {"sector_sentiment": (sentiment_weight, 1)}
    scores, _ = process_factors(d, by, "code", industry, factors, min_coverage=min_coverage, not_demeaned=("sector_sentiment",))
    kept = [c for c in dict.fromkeys([state, "rule", *momentum, *quality, *risk]) if c not in scores.columns]
    scored = scores.filter(~F.col("low_coverage")).join(d.select(*by, "code", *kept), [*by, "code"])
    moved = regime_policy(scored, by, state, profile, list(momentum), list(quality), list(risk))
    pick = F.row_number().over(W.partitionBy(*by).orderBy(F.round("score", 6).desc(), "code"))
    out = moved.withColumn("pick", pick).withColumn("selected", F.col("pick") <= top_n).withColumn("warning", F.when(F.col("rule") == "relaxed", "hard_filters_empty_relaxed"))
    return out.select(*by, "code", industry, "rule", "coverage", "top", F.col("base_score_before_regime").alias("base_score"), "score", "pick", "selected", "warning")


def backtest_regime(daily: DataFrame, ret: str, date: str) -> DataFrame:
    """risk_off, risk_on or mixed from the benchmark's last 20 returns, unknown with fewer. daily has a row a date."""
    w = W.orderBy(date).rowsBetween(-19, 0)
    momentum = F.exp(F.sum(F.log1p(ret)).over(w)) - 1
    vol = F.stddev_pop(ret).over(w) * 252**0.5
    d = daily.withColumn("__n", F.count(ret).over(w)).withColumn("momentum_20", momentum).withColumn("volatility_20", vol)
    state = F.when(F.col("__n") < 20, "unknown").when((F.col("momentum_20") < -0.03) | (F.col("volatility_20") > 0.30), "risk_off").when((F.col("momentum_20") > 0.02) & (F.col("volatility_20") < 0.28), "risk_on").otherwise("mixed")
    return d.withColumn("state", state).drop("__n")


def oos_portfolio(evaluation: DataFrame, strategy: str, horizon: int, cost: float = 0.0015) -> DataFrame:
    """Out-of-sample metrics of a strategy's scores on every horizon-th date: the best fifth, with names of the book kept within the best
    three tenths, turnover charged at `cost`, excess over the date's mean.

    evaluation: strategy, trade_date, code, score, excess_return. A strategy's book is sequential, so a strategy is one group; it gets
    its rebalance dates and, of each, the best three tenths.
    """
    dates = evaluation.select(strategy, "trade_date").distinct().withColumn("__i", F.row_number().over(W.partitionBy(strategy).orderBy("trade_date")) - 1)
    d = evaluation.join(dates.filter(F.col("__i") % max(1, horizon) == 0).drop("__i"), [strategy, "trade_date"])
    w = W.partitionBy(strategy, "trade_date")
    d = d.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__mean", F.avg("excess_return").over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.desc("score"), "code")))
    top = d.filter((F.col("__r") <= F.ceil(F.col("__n") * 0.3)) | (F.col("__r") == 1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        book, returns, turnovers = None, [], []
        for _, day in pdf.sort_values(["trade_date", "__r"]).groupby("trade_date", sort=True):
            count = max(1, math.ceil(int(day["__n"].iloc[0]) * 0.20))
            value = dict(zip(day["code"], day["excess_return"]))
            codes = day["code"].tolist()
            if book:
                kept = [c for c in codes if c in book]
                now = {*kept, *[c for c in codes if c not in book][: max(0, count - len(kept))]}
                turnover = 1 - len(now & book) / max(len(now), len(book), 1)
            else:
                now, turnover = set(codes[:count]), 0.0
            held = [value[c] for c in now if value[c] == value[c]]
            returns.append((float(np.mean(held)) if held else math.nan) - float(day["__mean"].iloc[0]) - turnover * cost)
            turnovers.append(turnover)
            book = now
        r, year = np.clip(np.array(returns), -0.99, None), 252 / max(1, horizon)
        curve = np.cumsum(r)
        sd = float(np.std(r, ddof=1)) if len(r) > 1 else 0.0
        row = (float(r.mean() * year), float(abs((curve - np.maximum.accumulate(curve)).min())), float(np.mean(turnovers) * year), float(r.mean() / sd * year**0.5) if sd > 1e-12 else 0.0, len(r))
        return pd.DataFrame([(pdf[strategy].iloc[0], *row)], columns=[strategy, "net_excess_return", "max_drawdown", "annual_turnover", "portfolio_sharpe", "periods"])

    kind = evaluation.schema[strategy].dataType.simpleString()
    return top.select(strategy, "trade_date", "code", "excess_return", "__n", "__mean", "__r").groupBy(strategy).applyInPandas(run, f"{strategy} {kind}, net_excess_return double, max_drawdown double, annual_turnover double, portfolio_sharpe double, periods int")


#: Fixed value: the standard normal's 90 % quantile.
NORMAL_90 = 1.281551565545


def cost_aware_transition(book: DataFrame, by: list[str], top_n: int, rank_buffer: float, band: float, rate: float, max_turnover: float, safety: float, persistence: float = 1.0, exposure: float = 1.0) -> DataFrame:
    """A step from current weights towards aimed ones where the expected edge pays for the trade, with the reason of each decision.

    book: by, code, score (null: held, but no candidate), aim, current (weights, null is 0), expected (excess return), cost_bps, uncertainty_bps, risk_exit (flag).
    Where uncertainty_bps is missing or negative it is that of the forecast: half the width of return_q10 to return_q90 in standard deviations,
    times 1 - confidence (null: sure); a missing quantile is the expected return.
    Held names within the rank buffer stay, best first, up to top_n; aimed ones fill up. A change below `band`, or whose edge is not over
    safety x cost + uncertainty, is not made; others go `rate` of the way, all scaled to max_turnover; buys are scaled so that
    weights stay within `exposure`. Risk exits go at once and whole. All of it is windows over one account and day.
    """
    w = W.partitionBy(*by)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    d = book.withColumn("current", F.greatest(zero("current"), F.lit(0.0))).withColumn("aim", F.greatest(zero("aim"), F.lit(0.0))).withColumn("expected", zero("expected"))
    if "return_q10" in d.columns and "return_q90" in d.columns:
        sure = F.least(F.greatest(F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in d.columns else F.lit(1.0), F.lit(0.0)), F.lit(1.0))
        width = F.abs(F.coalesce("return_q90", "expected") - F.coalesce("return_q10", "expected"))
        given = F.col("uncertainty_bps") if "uncertainty_bps" in d.columns else F.lit(None).cast("double")
        d = d.withColumn("uncertainty_bps", F.when(given >= 0, given).otherwise(width / (2 * NORMAL_90) * (1 - sure) * 10_000))
    limit = max(top_n, 1)
    buffer = max(limit, math.ceil(limit * (1 + max(rank_buffer, 0.0))))
    order = [F.col("score").desc_nulls_last(), F.col("code")]
    d = d.withColumn("rank", F.row_number().over(w.orderBy(*order)))
    d = d.withColumn("__stay", F.col("score").isNotNull() & (F.col("current") > 0) & (F.col("rank") <= buffer))
    d = d.withColumn("__stays", F.row_number().over(W.partitionBy(*by, "__stay").orderBy("rank")))
    d = d.withColumn("__retained", F.col("__stay") & (F.col("__stays") <= limit))
    kept = F.sum(F.col("__retained").cast("int")).over(w)
    d = d.withColumn("__kept", kept).withColumn("__new", F.col("score").isNotNull() & (F.col("aim") > 0) & ~F.col("__retained"))
    d = d.withColumn("__news", F.row_number().over(W.partitionBy(*by, "__new").orderBy("rank")))
    d = d.withColumn("__selected", F.col("__retained") | (F.col("__new") & (F.col("__news") <= F.lit(limit) - F.col("__kept"))))
    d = d.filter(F.col("__selected") | (F.col("current") > 0))
    hold = F.col("__retained") & (F.col("aim") <= 0)
    desired = F.when(hold, F.col("current")).when(F.col("__selected"), F.col("aim")).otherwise(0.0)
    best = F.coalesce(F.max(F.when(F.col("__selected"), F.col("expected"))).over(w), F.lit(0.0))
    d = d.withColumn("__hold", hold).withColumn("__desired", desired).withColumn("__best", best).withColumn("__delta", F.col("__desired") - F.col("current"))
    edge = F.when(F.col("__delta") >= 0, F.greatest(F.col("expected"), F.lit(0.0))).otherwise(F.greatest(F.col("__best") - F.col("expected"), -F.col("expected"), F.lit(0.0))) * max(persistence, 0.0) * 10_000
    d = d.withColumn("edge_bps", edge).withColumn("net_edge_bps", F.col("edge_bps") - F.greatest(zero("cost_bps"), F.lit(0.0)) * max(safety, 0.0) - F.greatest(zero("uncertainty_bps"), F.lit(0.0)))
    exit_ = truth(F.col("risk_exit")) & (F.col("current") > 0)
    reason = F.when(exit_, "hard_risk_exit").when(F.col("__hold"), "rank_buffer_hold").when(F.abs("__delta") < band, "target_change_below_band").when(F.col("net_edge_bps") <= 0, "insufficient_net_edge").when(F.lit(rate <= 0), "partial_adjustment_disabled").otherwise("")
    step = min(max(rate, 0.0), 1.0)
    d = d.withColumn("reason", reason).withColumn("__move", F.when(F.col("reason") == "hard_risk_exit", -F.col("current")).when(F.col("reason") == "", F.col("__delta") * step).otherwise(0.0))
    turnover = F.sum(F.when(F.col("reason") == "", F.abs("__move")).otherwise(0.0)).over(w)
    scale = F.when(turnover > 1e-12, F.least(F.lit(max(max_turnover, 0.0)) / turnover, F.lit(1.0))).otherwise(1.0)
    d = d.withColumn("__scale", scale).withColumn("__target", F.greatest(F.col("current") + F.when(F.col("reason") == "", F.col("__move") * F.col("__scale")).otherwise(F.col("__move")), F.lit(0.0)))
    over = F.sum("__target").over(w) - min(max(exposure, 0.0), 1.0)
    buy = F.when(F.col("reason") == "hard_risk_exit", 0.0).otherwise(F.greatest(F.col("__target") - F.col("current"), F.lit(0.0)))
    d = d.withColumn("__over", over).withColumn("__buy", buy).withColumn("__buys", F.sum("__buy").over(w))
    cut = F.when(F.col("__buys") > 1e-12, F.greatest(1 - F.col("__over") / F.col("__buys"), F.lit(0.0))).otherwise(0.0)
    # beyond the exposure every name but a risk exit goes back to its current weight plus the scaled buy, sells too
    target = F.when((F.col("__over") > 1e-12) & (F.col("reason") != "hard_risk_exit"), F.col("current") + F.col("__buy") * cut).otherwise(F.col("__target"))
    d = d.withColumn("target", F.greatest(target, F.lit(0.0))).withColumn("changed", F.abs(F.col("target") - F.col("current")) > 1e-12)
    d = d.withColumn("reason", F.when(F.col("changed") & (F.col("reason") != "hard_risk_exit"), "").otherwise(F.col("reason")))
    return d.select(*by, "code", "rank", "current", F.col("__desired").alias("aimed"), "target", "edge_bps", "net_edge_bps", "changed", "reason")


def degenerate_scores(scores: DataFrame, by: list[str], score: str, least_unique: float) -> DataFrame:
    """Samples whose share of distinct scores (to six digits) lies below `least_unique`; samples of one score never do."""
    g = scores.filter(F.col(score).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.round(score, 6)).alias("n_unique"))
    return g.filter("n >= 2").withColumn("unique_ratio", F.col("n_unique") / F.col("n")).filter(F.col("unique_ratio") < least_unique)
