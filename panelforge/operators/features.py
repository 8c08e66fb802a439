"""The feature view of ranking models: centered ranks by date and by industry, the market's state, and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.operators.xsec import pct_rank

#: Features ranked among the rows of a date.
STOCK = (
    "return_1", "momentum_5", "momentum_10", "momentum_20", "momentum_60", "momentum_120", "reversal_5",
    "sma_distance_5", "sma_distance_10", "sma_distance_20", "sma_distance_60", "sma_distance_120", "ema_distance_12", "ema_distance_26",
    "macd_dif_pct", "macd_dea_pct", "macd_hist_pct", "macd_hist_slope_pct", "rsi_14", "adx_14", "natr_14", "bollinger_position", "bollinger_width",
    "realized_volatility_5", "realized_volatility_20", "realized_volatility_60", "downside_volatility_20", "intraday_range", "close_location",
    "drawdown_60", "breakout_20", "relative_strength_20", "volume_ratio_5_20", "volume_zscore_20", "obv_flow_5", "ad_flow_5", "mfi_14",
    "amount_ratio_5_20", "amount_zscore_20", "amihud_illiquidity_20", "volume_price_correlation_20", "up_volume_ratio_20",
    "turnover_percentile_60", "turnover_change_5", "turnover_change_20", "price_volume_confirmation_20",
    "roe", "roic", "gross_margin", "net_profit_margin", "debt_ratio", "revenue_growth", "profit_growth", "cash_conversion", "accrual_ratio",
    "free_cashflow_to_assets", "gross_profit_to_assets", "pe_ttm", "pb", "industry_relative_momentum_20", "industry_breadth", "industry_cycle_score",
)
#: Money-flow features, features ranked within an industry too, and features that may be missing.
FLOW = ("moneyflow_net_ratio_1", "moneyflow_net_ratio_5", "moneyflow_net_ratio_20", "moneyflow_positive_days_5", "moneyflow_large_imbalance_5")
BY_INDUSTRY = ("momentum_20", "momentum_60", "realized_volatility_20", "price_volume_confirmation_20", "roe", "cash_conversion", "gross_profit_to_assets", "pe_ttm", "pb")
MAY_MISS = ("roe", "roic", "gross_margin", "net_profit_margin", "debt_ratio", "revenue_growth", "profit_growth", "cash_conversion", "accrual_ratio", "free_cashflow_to_assets", "gross_profit_to_assets", "pe_ttm", "pb", "moneyflow_net_ratio_20")


def _market(columns: list[str]) -> dict[str, Column]:
    """Aggregates of a date's rows: breadth, medians, dispersion and the share of rows in drawdown, of the columns that are there; missing values do not count."""
    x = lambda c: F.col(c).cast("double")
    share = lambda c, test: F.avg(F.when(x(c).isNotNull(), test.cast("double")))
    wanted = {
        "market_breadth_1": ("return_1", lambda c: share(c, x(c) > 0)),
        "market_median_momentum_20": ("momentum_20", lambda c: F.percentile(x(c), 0.5)),
        "market_median_momentum_60": ("momentum_60", lambda c: F.percentile(x(c), 0.5)),
        "market_cross_sectional_volatility_1": ("return_1", lambda c: F.stddev_samp(x(c))),
        "market_median_realized_volatility_20": ("realized_volatility_20", lambda c: F.percentile(x(c), 0.5)),
        "market_drawdown_breadth_60": ("drawdown_60", lambda c: share(c, x(c) < -0.10)),
    }
    return {name: of(c) for name, (c, of) in wanted.items() if c in columns}


def market_state(d: DataFrame, date: str = "trade_date") -> DataFrame:
    """A row a date with the aggregates of its rows."""
    return d.groupBy(date).agg(*[c.alias(name) for name, c in _market(d.columns).items()])


def feature_view(panel: DataFrame, code: str = "code", date: str = "trade_date", industry: str = "industry") -> DataFrame:
    """(code, date, <feature>_cs_rank, log_total_mv_cs_rank, <feature>_industry_rank, market_*, <feature>_missing) of the features that the panel has.

    Ranks are percentiles with averaged ties less their mean in the group; a missing value has none. A null industry is
    `unclassified`; total_mv that is not positive has no logarithm. (code, date) is a key. Rows move once; a feature is a sort within its date.
    """
    d = panel.withColumn(industry, F.coalesce(F.col(industry), F.lit("unclassified")))
    stock = [f for f in (*STOCK, *FLOW) if f in panel.columns]
    if "total_mv" in panel.columns:
        d, stock = d.withColumn("log_total_mv", F.when(F.col("total_mv") > 0, F.log("total_mv"))), [*stock, "log_total_mv"]
    within, missing = [f for f in BY_INDUSTRY if f in panel.columns], [f for f in MAY_MISS if f in panel.columns]
    # dealt out by date once: windows of a date and of an industry of a date lie in it
    d = d.select(code, date, industry, *[F.col(f).cast("double").alias(f) for f in dict.fromkeys([*stock, *within, *missing])]).repartition(date)
    ranks = {f"{f}_cs_rank": (f, [date]) for f in stock} | {f"{f}_industry_rank": (f, [date, industry]) for f in within}
    d = d.withColumns({name: pct_rank(f, by) for name, (f, by) in ranks.items()})
    centered = [(F.col(name) - F.avg(name).over(W.partitionBy(*by))).alias(name) for name, (_, by) in ranks.items()]
    market = [c.over(W.partitionBy(date)).alias(name) for name, c in _market(d.columns).items()]
    return d.select(date, code, *[F.col(f).isNull().cast("double").alias(f"{f}_missing") for f in missing], *centered, *market)


def sequences(panel: DataFrame, features: list[str], length: int, least: int, code: str = "code", date: str = "trade_date") -> DataFrame:
    """(code, date, observed, values, valid) of every row with at least `least` rows of its code among its last `length`: per feature an array of `length` values
    and one of as many flags, oldest first. Places before a code's first row and missing values are 0 with flag 0, so batches are even."""
    w = W.partitionBy(code).orderBy(date).rowsBetween(-(length - 1), 0)
    rows = F.collect_list(F.struct(*[F.col(f).cast("double").alias(f) for f in features])).over(w)
    d = panel.select(code, date, rows.alias("__r")).withColumn("observed", F.size("__r")).filter(F.col("observed") >= least)
    pad = lambda zero: F.array_repeat(zero, length - F.col("observed"))
    ok = lambda x: x.isNotNull() & ~F.isnan(x)
    of = lambda f: (lambda r: F.when(ok(r[f]), r[f]).otherwise(0.0), lambda r: ok(r[f]).cast("int"))
    values = F.struct(*[F.concat(pad(F.lit(0.0)), F.transform("__r", of(f)[0])).alias(f) for f in features])
    valid = F.struct(*[F.concat(pad(F.lit(0)), F.transform("__r", of(f)[1])).alias(f) for f in features])
    return d.select(code, date, "observed", values.alias("values"), valid.alias("valid"))


def contexts(panel: DataFrame, features: list[str], date: str = "trade_date", industry: str = "industry") -> tuple[DataFrame, DataFrame]:
    """((date, industry, n, means), (date, n, means)): what a row's industry and the market hold on its date. A code meets its neighbours through the industry's row,
    so no pair of codes is formed; missing values do not count."""
    mean = [F.avg(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))).alias(f) for f in features]
    d = panel.withColumn(industry, F.coalesce(F.col(industry), F.lit("unclassified")))
    n = F.count(F.lit(1)).alias("n")
    return d.groupBy(date, industry).agg(n, *mean), d.groupBy(date).agg(n, *mean)
