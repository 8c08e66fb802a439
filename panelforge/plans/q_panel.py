"""Cross-sectional, rolling and technical operators, labels, events, regimes and scoring as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.operators import events as ev
from panelforge.operators import labels as lab
from panelforge.operators import pit, regime, roll, technical, xsec
from panelforge.plans.base import MEMBERS, PANEL, RETURNS, UNIVERSE, members, panel, query, universe, with_returns
from panelforge.plans.q_pit import rank_sql

WC = "PARTITION BY code ORDER BY trade_date"


def roll_sql(fn: str, x: str, n: int, least: int | None = None, extra: str = "") -> str:
    frame = f"OVER ({WC} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {n if least is None else least} THEN {fn}({x}{extra}) {frame} END"


@query("r1_r2_pct_and_centered_rank", f"WITH {RETURNS}, r AS (SELECT code, trade_date, {rank_sql('return_1', 'trade_date')} AS rank FROM returns) SELECT code, trade_date, rank, rank - avg(rank) OVER (PARTITION BY trade_date) AS centered FROM r", "rank centered")
def _(t):
    d = with_returns(t).withColumn("rank", xsec.pct_rank("return_1", ["trade_date"]))
    return xsec.centered_rank(d, "return_1", ["trade_date"], "centered").select("code", "trade_date", "rank", "centered")


@query("r3_winsorize", f"""WITH {UNIVERSE}, q AS (SELECT trade_date, quantile_cont(close, 0.05) AS lo, quantile_cont(close, 0.95) AS hi FROM universe GROUP BY 1) SELECT code, trade_date, least(greatest(close, lo), hi) AS clipped FROM universe JOIN q USING (trade_date)""", "clipped")
def _(t):
    return xsec.winsorize(universe(t), "close", ["trade_date"], 0.05, 0.95, "clipped").select("code", "trade_date", "clipped")


@query("r4_r5_zscore_neutralize", f"""WITH {UNIVERSE}, z AS (SELECT code, trade_date, industry, CASE WHEN stddev_pop(volume) OVER w > 0 THEN (volume - avg(volume) OVER w) / stddev_pop(volume) OVER w ELSE 0 END AS z FROM universe WINDOW w AS (PARTITION BY trade_date))
 SELECT code, trade_date, z, z - avg(z) OVER (PARTITION BY trade_date, industry) AS neutral FROM z""", "z neutral")
def _(t):
    d = universe(t).withColumn("z", xsec.zscore("volume", ["trade_date"]))
    return d.withColumn("neutral", xsec.neutralize("z", ["trade_date"], "industry")).select("code", "trade_date", "z", "neutral")


@query("r6_account_feature_view", f"""WITH {RETURNS}, f AS (SELECT *, {roll_sql('stddev_samp', 'return_1', 20)} AS vol, {roll_sql('avg', 'amount', 20)} AS adv, {roll_sql('avg', 'close', 200)} AS sma FROM returns)
 SELECT code, trade_date, close / sma - 1 AS distance, return_1 - avg(return_1) OVER (PARTITION BY trade_date) AS residual, 1 - {rank_sql('vol', 'trade_date')} AS low_vol, {rank_sql('adv', 'trade_date')} AS liquidity FROM f""", "distance residual low_vol liquidity")
def _(t):
    d = with_returns(t).withColumn("vol", roll.std("return_1", 20)).withColumn("adv", roll.mean("amount", 20)).withColumn("sma", roll.mean("close", 200))
    return d.select("code", "trade_date", (F.col("close") / F.col("sma") - 1).alias("distance"), (F.col("return_1") - F.avg("return_1").over(W.partitionBy("trade_date"))).alias("residual"), (1 - xsec.pct_rank("vol", ["trade_date"])).alias("low_vol"), xsec.pct_rank("adv", ["trade_date"]).alias("liquidity"))


@query("r7_long_form_ranks", f"""WITH {RETURNS}, l AS (SELECT code, trade_date, feature, value FROM (SELECT code, trade_date, close, volume, amount, return_1 FROM returns) UNPIVOT INCLUDE NULLS (value FOR feature IN (close, volume, amount, return_1))),
 r AS (SELECT code, trade_date, feature, {rank_sql('value', 'trade_date, feature')} AS rank FROM l) SELECT code, trade_date, feature, rank - avg(rank) OVER (PARTITION BY trade_date, feature) AS rank FROM r""", "rank")
def _(t):
    return xsec.long_ranks(with_returns(t), ["code", "trade_date"], ["close", "volume", "amount", "return_1"], ["trade_date"]).select("code", "trade_date", "feature", "rank")


@query("r8_sample_weights", f"""WITH {PANEL}, d AS (SELECT trade_date, count(*) AS n, row_number() OVER (ORDER BY trade_date DESC) - 1 AS age FROM panel GROUP BY 1), w AS (SELECT trade_date, n, power(0.5, age / 250.0) / n AS w FROM d)
 SELECT code, trade_date, 1.0 / n AS balanced, w / (SELECT sum(w * n) / sum(n) FROM w) AS recency FROM panel JOIN w USING (trade_date)""", "balanced recency")
def _(t):
    d = xsec.date_balanced_weights(panel(t).select("code", "trade_date"), "trade_date", "balanced")
    return xsec.recency_weights(d, "trade_date", 250.0, "recency").select("code", "trade_date", "balanced", "recency")


@query("r9_r10_targets", f"WITH {RETURNS} SELECT code, trade_date, {rank_sql('return_1', 'trade_date')} - 0.5 AS target, CAST(least(floor({rank_sql('return_1', 'trade_date')} * 5), 4) AS INTEGER) AS relevance FROM returns", "target")
def _(t):
    r = xsec.pct_rank("return_1", ["trade_date"])
    return with_returns(t).withColumn("r", r).select("code", "trade_date", (F.col("r") - 0.5).alias("target"), xsec.relevance_bins("r", 5).alias("relevance"))


@query("r11_scores_neutralized")
def _(t):
    d = universe(t).withColumn("size", F.log("amount"))
    return xsec.neutralize_scores(d.select("code", "trade_date", "close", "industry", "size", "volume"), "trade_date", "close", ["size", "volume"], "industry", "neutral").select("code", "trade_date", "neutral")


@query("r12_size_neutral_rank", f"""WITH {UNIVERSE}, s AS (SELECT *, ln(amount) AS size FROM universe), g AS (SELECT trade_date, count(*) AS n, stddev_pop(size) AS sd, regr_slope(close, size) AS slope, regr_intercept(close, size) AS icept, avg(close) AS m FROM s GROUP BY 1)
 SELECT code, trade_date, CASE WHEN n >= 3 AND sd > 1e-12 THEN close - icept - slope * size ELSE close - m END AS residual FROM s JOIN g USING (trade_date)""", "residual", 4)
def _(t):
    d = universe(t).withColumn("size", F.log("amount"))
    return xsec.regression_residual(d, "close", "size", ["trade_date"], "residual").select("code", "trade_date", "residual")


@query("w1_changes", f"WITH {PANEL} SELECT code, trade_date, close / lag(close) OVER ({WC}) - 1 AS r1, close / lag(close, 5) OVER ({WC}) - 1 AS r5, volume - lag(volume) OVER ({WC}) AS dv, lead(close) OVER ({WC}) AS next FROM panel", "r1 r5 dv next")
def _(t):
    w = roll.series()
    return panel(t).select("code", "trade_date", roll.change("close").alias("r1"), roll.change("close", 5).alias("r5"), (F.col("volume") - F.lag("volume").over(w)).alias("dv"), F.lead("close").over(w).alias("next"))


@query("w2_rolling_windows", f"WITH {PANEL} SELECT code, trade_date, {roll_sql('avg', 'close', 20)} AS mean20, {roll_sql('sum', 'volume', 5, 3)} AS vol5, {roll_sql('stddev_samp', 'close', 20, 10)} AS sd20, {roll_sql('max', 'high', 20)} AS top, {roll_sql('min', 'low', 20)} AS bottom, {roll_sql('median', 'close', 20)} AS med, {roll_sql('quantile_cont', 'close', 20, None, ', 0.9')} AS q90 FROM panel", "mean20 vol5 sd20 top bottom med q90")
def _(t):
    q90 = roll.rolling(lambda c: F.percentile(c, 0.9), "close", 20)
    return panel(t).select("code", "trade_date", roll.mean("close", 20).alias("mean20"), roll.total("volume", 5, 3).alias("vol5"), roll.std("close", 20, 10).alias("sd20"), roll.rolling(F.max, "high", 20).alias("top"), roll.rolling(F.min, "low", 20).alias("bottom"), roll.median("close", 20).alias("med"), q90.alias("q90"))


@query("w3_rolling_percentile", f"WITH {PANEL}, l AS (SELECT code, trade_date, volume, list(volume) OVER ({WC} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS a FROM panel) SELECT code, trade_date, CASE WHEN len(a) >= 20 THEN len(list_filter(a, lambda v: v <= volume)) / len(a) END AS pct FROM l", "pct")
def _(t):
    return panel(t).select("code", "trade_date", roll.rolling_percentile("volume", 60, 20).alias("pct"))


@query("w4_rolling_correlation", f"WITH {RETURNS}, v AS (SELECT *, ln(1 + volume) - lag(ln(1 + volume)) OVER ({WC}) AS lv FROM returns) SELECT code, trade_date, CASE WHEN count(return_1) OVER w >= 20 THEN corr(return_1, lv) OVER w END AS corr FROM v WINDOW w AS ({WC} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "corr")
def _(t):
    d = with_returns(t).withColumn("lv", F.log1p("volume") - F.lag(F.log1p("volume")).over(roll.series()))
    return d.select("code", "trade_date", roll.rolling_corr("return_1", "lv", 20, flat=float("nan")).alias("corr"))


@query("w5_time_since_event", f"WITH {RETURNS}, n AS (SELECT *, row_number() OVER ({WC}) AS i FROM returns) SELECT code, trade_date, CAST(i - last_value(CASE WHEN return_1 > 0.5 THEN i END IGNORE NULLS) OVER ({WC} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS age FROM n", "age")
def _(t):
    return with_returns(t).select("code", "trade_date", roll.since(F.col("return_1") > 0.5).cast("double").alias("age"))


@query("w6_drawdown", f"WITH {PANEL}, d AS (SELECT *, close / max(close) OVER ({WC} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM panel) SELECT code, min(dd) AS max_drawdown, arg_min(trade_date, {{'a': dd, 'b': trade_date}}) AS trough FROM d GROUP BY 1", "max_drawdown")
def _(t):
    d = panel(t).withColumn("dd", roll.drawdown("close"))
    return d.groupBy("code").agg(F.min("dd").alias("max_drawdown"), F.min_by("trade_date", F.struct("dd", "trade_date")).alias("trough"))


MARKET = f"{RETURNS}, market AS (SELECT trade_date, avg(return_1) AS ret, sum(amount) AS amount, count(*) AS n, avg(CASE WHEN return_1 > 0 THEN 1.0 ELSE 0 END) AS breadth FROM returns GROUP BY 1)"


def market(t):
    above = F.coalesce((F.col("return_1") > 0).cast("double"), F.lit(0.0))
    return with_returns(t).groupBy("trade_date").agg(F.avg("return_1").alias("ret"), F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"), F.avg(above).alias("breadth"))


MONTHLY = "monthly AS (SELECT o_orderstatus AS scope, strftime(o_orderdate, '%Y%m') AS m, count(*)::DOUBLE AS x FROM orders GROUP BY 1, 2)"


def monthly(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("scope"), F.date_format("o_orderdate", "yyyyMM").alias("m")).agg(F.count(F.lit(1)).cast("double").alias("x"))


ROBUST = f"""{MONTHLY}, e AS (SELECT *, list(x) OVER w AS v, median(x) OVER w AS med, stddev_pop(x) OVER w AS sd FROM monthly WINDOW w AS (PARTITION BY scope ORDER BY m ROWS UNBOUNDED PRECEDING)),
 f AS (SELECT *, list_aggregate(list_transform(v, lambda y: abs(y - med)), 'median') AS mad FROM e),
 robust AS (SELECT scope, m, CASE WHEN len(v) < 3 THEN 0 WHEN mad > 1e-12 THEN greatest(least((x - med) / (1.4826 * mad), 5), -5) WHEN sd > 1e-12 THEN greatest(least((x - med) / sd, 5), -5) ELSE 0 END AS z FROM f)"""


@query("w7_expanding_robust_z", f"WITH {ROBUST} SELECT scope, m, z FROM robust", "z")
def _(t):
    return roll.expanding_robust_z(monthly(t), "x", "z", ["scope"], "m").select("scope", "m", "z")


@query("w8_w9_residual_momentum", f"""WITH {RETURNS}, f AS (SELECT code, trade_date, return_1 AS y, avg(return_1) OVER (PARTITION BY trade_date) AS a, ln(1 + volume) AS b FROM returns), g AS (SELECT *, y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AS ok FROM f),
 h AS (SELECT *, count(*) FILTER (WHERE ok) OVER w AS n, coalesce(sum(a) FILTER (WHERE ok) OVER w, 0) AS sa, coalesce(sum(b) FILTER (WHERE ok) OVER w, 0) AS sb, coalesce(sum(y) FILTER (WHERE ok) OVER w, 0) AS sy, coalesce(sum(a * a) FILTER (WHERE ok) OVER w, 0) + 1e-8 AS saa, coalesce(sum(b * b) FILTER (WHERE ok) OVER w, 0) + 1e-8 AS sbb, coalesce(sum(a * b) FILTER (WHERE ok) OVER w, 0) AS sab, coalesce(sum(a * y) FILTER (WHERE ok) OVER w, 0) AS say, coalesce(sum(b * y) FILTER (WHERE ok) OVER w, 0) AS sby FROM g WINDOW w AS ({WC} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
 k AS (SELECT *, n + 1e-8 AS m, (n + 1e-8) * (saa * sbb - sab * sab) - sa * (sa * sbb - sab * sb) + sb * (sa * sab - saa * sb) AS det FROM h),
 c AS (SELECT *, (sy * (saa * sbb - sab * sab) - sa * (say * sbb - sab * sby) + sb * (say * sab - saa * sby)) / det AS b0, (m * (say * sbb - sab * sby) - sy * (sa * sbb - sab * sb) + sb * (sa * sby - say * sb)) / det AS b1, (m * (saa * sby - say * sab) - sa * (sa * sby - say * sb) + sy * (sa * sab - saa * sb)) / det AS b2 FROM k),
 r AS (SELECT code, trade_date, CASE WHEN ok AND n >= 30 AND abs(det) > 0 THEN y - b0 - b1 * a - b2 * b END AS residual FROM c)
 SELECT code, trade_date, residual, CASE WHEN count(residual) OVER s >= 30 AND stddev_samp(residual) OVER s > 1e-9 THEN sum(residual) OVER s / (stddev_samp(residual) OVER s * sqrt(56)) END AS residual_momentum FROM r WINDOW s AS ({WC} ROWS BETWEEN 60 PRECEDING AND 5 PRECEDING)""", "residual residual_momentum", 4)
def _(t):
    d = with_returns(t)
    d = d.withColumn("market", F.avg("return_1").over(W.partitionBy("trade_date"))).withColumn("sector", F.log1p("volume"))  # nations have one code a day: their mean would leave no residual
    return roll.residual_momentum(d, "return_1", "market", "sector", 60, 30, 5).select("code", "trade_date", "residual", "residual_momentum")


@query("w13_flow_ratios", f"""WITH {PANEL}, f AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, strftime(l_shipdate, '%Y%m%d') AS trade_date, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS net FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
 j AS (SELECT code, trade_date, net, CASE WHEN net IS NOT NULL THEN amount END AS amount FROM panel LEFT JOIN f USING (code, trade_date))
 SELECT code, trade_date, {roll_sql('sum', 'net', 5, 3)} / nullif({roll_sql('sum', 'amount', 5, 3)}, 0) AS flow_5, {roll_sql('avg', 'CASE WHEN net > 0 THEN 1.0 WHEN net IS NOT NULL THEN 0 END', 20, 10)} AS positive_20, CAST(net IS NOT NULL AS INTEGER) AS observed FROM j""", "flow_5 positive_20")
def _(t):
    from panelforge.functions.scalar import code_key, safe_ratio

    net = F.round(F.sum(F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))), 2)
    f = t.lineitem.filter("l_linestatus = 'O'").groupBy(code_key(F.col("l_suppkey")).alias("code"), F.date_format("l_shipdate", "yyyyMMdd").alias("trade_date")).agg(net.alias("net"))
    d = panel(t).join(f, ["code", "trade_date"], "left").withColumn("amount", F.when(F.col("net").isNotNull(), F.col("amount"))).withColumn("up", F.when(F.col("net").isNotNull(), (F.col("net") > 0).cast("double")))
    return d.select("code", "trade_date", safe_ratio(roll.total("net", 5, 3), roll.total("amount", 5, 3)).alias("flow_5"), roll.mean("up", 20, 10).alias("positive_20"), F.col("net").isNotNull().cast("int").alias("observed"))


@query("w14_peer_tracking_error", f"""WITH {RETURNS}, lead AS (SELECT industry, arg_max(code, {{'a': v, 'b': code}}) AS peer FROM (SELECT industry, code, round(sum(amount), 2) AS v FROM returns GROUP BY 1, 2) GROUP BY 1),
 d AS (SELECT r.code, r.trade_date, r.return_1 - p.return_1 AS x FROM returns r JOIN lead USING (industry) JOIN returns p ON p.code = peer AND p.trade_date = r.trade_date WHERE r.code <> peer AND r.return_1 IS NOT NULL AND p.return_1 IS NOT NULL),
 n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS i FROM d) SELECT code, stddev_samp(x) * sqrt(252) AS te FROM n WHERE i <= 60 GROUP BY 1 HAVING count(*) >= 20""", "te", 5)
def _(t):
    r = with_returns(t)
    lead = r.groupBy("industry", "code").agg(F.round(F.sum("amount"), 2).alias("v")).groupBy("industry").agg(F.max_by("code", F.struct("v", "code")).alias("peer"))
    p = r.select(F.col("code").alias("peer"), "trade_date", F.col("return_1").alias("pr"))
    d = r.join(lead, "industry").filter("code <> peer").join(p, ["peer", "trade_date"]).withColumn("x", F.col("return_1") - F.col("pr")).filter("x is not null")
    d = d.withColumn("i", F.row_number().over(W.partitionBy("code").orderBy(F.desc("trade_date")))).filter("i <= 60")
    return d.groupBy("code").agg((F.stddev_samp("x") * 252**0.5).alias("te"), F.count(F.lit(1)).alias("n")).filter("n >= 20").select("code", "te")


@query("t1_t7_trend_and_bands", f"WITH {PANEL}, s AS (SELECT code, trade_date, close, {roll_sql('avg', 'close', 5)} AS sma_5, {roll_sql('avg', 'close', 20)} AS sma_20, {roll_sql('avg', 'close', 60)} AS sma_60, {roll_sql('stddev_pop', 'close', 20)} AS sd FROM panel) SELECT code, trade_date, sma_5, close / sma_20 - 1 AS sma_20_distance, sma_60, sma_20 + 2 * sd AS bollinger_upper, 4 * sd / sma_20 AS bollinger_width FROM s", "sma_5 sma_20_distance sma_60 bollinger_upper bollinger_width")
def _(t):
    return technical.bollinger(technical.trend(panel(t))).select("code", "trade_date", "sma_5", "sma_20_distance", "sma_60", "bollinger_upper", "bollinger_width")


TECH = f"""{PANEL}, tp AS (SELECT code, trade_date, high, low, close, row_number() OVER w AS i, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl, avg(close) OVER (w ROWS 11 PRECEDING) AS m12, avg(close) OVER (w ROWS 25 PRECEDING) AS m26 FROM panel WINDOW w AS ({WC})),
 tq AS (SELECT *, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS dn, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS plus, CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS minus FROM tp),
 ts AS (SELECT *, avg(up) OVER (w ROWS 13 PRECEDING) AS mu, avg(dn) OVER (w ROWS 13 PRECEDING) AS md, avg(tr) OVER (w ROWS 13 PRECEDING) AS mt, sum(plus) OVER (w ROWS 12 PRECEDING) AS sp, sum(minus) OVER (w ROWS 12 PRECEDING) AS sm, sum(tr) OVER (w ROWS 12 PRECEDING) AS st FROM tq WINDOW w AS ({WC})),
 rec AS (SELECT code, i, trade_date, NULL::DOUBLE AS e12, NULL::DOUBLE AS e26, NULL::DOUBLE AS f12, NULL::DOUBLE AS dea, 0::DOUBLE AS sd, NULL::DOUBLE AS au, NULL::DOUBLE AS ad, NULL::DOUBLE AS atr, NULL::DOUBLE AS dp, NULL::DOUBLE AS dm, NULL::DOUBLE AS dt, NULL::DOUBLE AS adx, 0::DOUBLE AS sx, close FROM ts WHERE i = 1
  UNION ALL SELECT code, i, trade_date, e12, e26, f12, CASE WHEN i = 34 THEN (sd + f12 - e26) / 9 WHEN i > 34 THEN dea + 0.2 * (f12 - e26 - dea) END, CASE WHEN i >= 26 THEN sd + f12 - e26 ELSE 0 END, au, ad, atr, dp, dm, dt, CASE WHEN i = 28 THEN (sx + dx) / 14 WHEN i > 28 THEN (adx * 13 + dx) / 14 END, CASE WHEN i >= 15 THEN sx + dx ELSE 0 END, close
  FROM (SELECT *, CASE WHEN dp + dm = 0 THEN 0 ELSE 100 * abs(dp - dm) / (dp + dm) END AS dx FROM (SELECT s.code, s.i, s.trade_date, s.close, r.dea, r.sd, r.adx, r.sx, CASE WHEN s.i = 12 THEN m12 WHEN s.i > 12 THEN r.e12 + 2.0 / 13 * (s.close - r.e12) END AS e12, CASE WHEN s.i = 26 THEN m26 WHEN s.i > 26 THEN r.e26 + 2.0 / 27 * (s.close - r.e26) END AS e26,
   CASE WHEN s.i = 26 THEN m12 WHEN s.i > 26 THEN r.f12 + 2.0 / 13 * (s.close - r.f12) END AS f12, CASE WHEN s.i = 15 THEN mu WHEN s.i > 15 THEN (r.au * 13 + up) / 14 END AS au, CASE WHEN s.i = 15 THEN md WHEN s.i > 15 THEN (r.ad * 13 + dn) / 14 END AS ad, CASE WHEN s.i = 15 THEN mt WHEN s.i > 15 THEN (r.atr * 13 + tr) / 14 END AS atr,
   CASE WHEN s.i = 14 THEN sp WHEN s.i > 14 THEN r.dp - r.dp / 14 + plus END AS dp, CASE WHEN s.i = 14 THEN sm WHEN s.i > 14 THEN r.dm - r.dm / 14 + minus END AS dm, CASE WHEN s.i = 14 THEN st WHEN s.i > 14 THEN r.dt - r.dt / 14 + tr END AS dt FROM rec r JOIN ts s ON s.code = r.code AND s.i = r.i + 1))),
 tech AS (SELECT code, trade_date, e12 AS ema_12, e26 AS ema_26, CASE WHEN dea IS NOT NULL THEN f12 - e26 END AS macd_dif, dea AS macd_dea, f12 - e26 - dea AS macd_hist, CASE WHEN au + ad = 0 THEN 0 ELSE 100 * au / (au + ad) END AS rsi_14, adx AS adx_14, atr AS atr_14, 100 * atr / close AS natr_14 FROM rec),
 tech_state AS (SELECT *, macd_hist - lag(macd_hist) OVER w AS macd_hist_slope, CASE WHEN macd_hist > 0 AND lag(macd_hist) OVER w <= 0 THEN 1 WHEN macd_hist < 0 AND lag(macd_hist) OVER w >= 0 THEN -1 ELSE 0 END AS macd_cross, row_number() OVER w AS i FROM tech WINDOW w AS ({WC}))"""


@query("t2_t6_recursive_indicators", f"WITH RECURSIVE {TECH} SELECT code, trade_date, ema_12, ema_26, macd_dif, macd_dea, macd_hist, rsi_14, adx_14, atr_14, natr_14, macd_cross, CAST(i - max(CASE WHEN macd_cross <> 0 THEN i END) OVER ({WC} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS macd_cross_age FROM tech_state", "ema_12 ema_26 macd_dif macd_dea macd_hist rsi_14 adx_14 atr_14 natr_14", 4)
def _(t):
    d = technical.macd_state(technical.recursive(panel(t)))
    return d.select("code", "trade_date", *technical.RECURSIVE, "macd_cross", F.col("macd_cross_age").cast("double").alias("macd_cross_age"))


@query("t8_t9_momentum_volatility", f"WITH {RETURNS} SELECT code, trade_date, return_1, close / lag(close, 20) OVER ({WC}) - 1 AS momentum_20, 1 - close / lag(close, 5) OVER ({WC}) AS reversal_5, {roll_sql('stddev_samp', 'return_1', 20)} * sqrt(252) AS volatility_20, {roll_sql('stddev_samp', 'CASE WHEN return_1 IS NOT NULL THEN least(return_1, 0) END', 20)} * sqrt(252) AS downside_volatility_20 FROM returns", "return_1 momentum_20 reversal_5 volatility_20 downside_volatility_20")
def _(t):
    return technical.volatility(technical.momentum(panel(t))).select("code", "trade_date", "return_1", "momentum_20", "reversal_5", "volatility_20", "downside_volatility_20")


@query("t10_price_action", f"""WITH {PANEL} SELECT code, trade_date, (close / lag(close, 20) OVER ({WC}) - 1) / 20 AS price_slope_20, open / lag(close) OVER ({WC}) - 1 AS gap_return, (high - low) / close AS intraday_range, (close - low) / nullif(high - low, 0) AS close_location,
 close / {roll_sql('max', 'high', 60).replace('max', 'max')} - 1 AS drawdown_60, CASE WHEN count(high) OVER p >= 20 THEN CAST(close > max(high) OVER p AS DOUBLE) END AS breakout_20 FROM panel WINDOW p AS ({WC} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""".replace("max(high) OVER (PARTITION", "max(close) OVER (PARTITION").replace("count(high) OVER (PARTITION", "count(close) OVER (PARTITION"), "price_slope_20 gap_return intraday_range close_location drawdown_60 breakout_20")
def _(t):
    return technical.price_action(panel(t)).select("code", "trade_date", "price_slope_20", "gap_return", "intraday_range", "close_location", "drawdown_60", F.col("breakout_20").cast("double").alias("breakout_20"))


@query("t11_relative_strength", f"WITH {PANEL}, b AS (SELECT trade_date, avg(close) AS benchmark FROM panel GROUP BY 1), j AS (SELECT * FROM panel JOIN b USING (trade_date)) SELECT code, trade_date, close / lag(close, 20) OVER ({WC}) - benchmark / lag(benchmark, 20) OVER ({WC}) AS relative_strength_20 FROM j", "relative_strength_20")
def _(t):
    p = panel(t)
    return technical.relative_strength(p.join(p.groupBy("trade_date").agg(F.avg("close").alias("benchmark")), "trade_date"), "benchmark").select("code", "trade_date", "relative_strength_20")


@query("t12_volume", f"""WITH {PANEL}, a AS (SELECT *, close - lag(close) OVER ({WC}) AS d, (high + low + close) / 3 AS tp FROM panel), b AS (SELECT *, sum(coalesce(sign(d) * volume, 0)) OVER ({WC} ROWS UNBOUNDED PRECEDING) AS obv, lag(tp) OVER ({WC}) AS ltp FROM a),
 c AS (SELECT *, CASE WHEN ltp IS NOT NULL THEN CASE WHEN tp > ltp THEN tp * volume ELSE 0 END END AS up, CASE WHEN ltp IS NOT NULL THEN CASE WHEN tp < ltp THEN tp * volume ELSE 0 END END AS down FROM b)
 SELECT code, trade_date, {roll_sql('avg', 'volume', 5)} / {roll_sql('avg', 'volume', 20)} AS volume_ratio_5_20, (volume - {roll_sql('avg', 'volume', 20)}) / nullif({roll_sql('stddev_samp', 'volume', 20)}, 0) AS volume_z_20, (obv - lag(obv, 5) OVER ({WC})) / nullif({roll_sql('sum', 'volume', 5)}, 0) AS obv_flow_5,
 100 * {roll_sql('sum', 'up', 14)} / nullif({roll_sql('sum', 'up', 14)} + {roll_sql('sum', 'down', 14)}, 0) AS mfi_14 FROM c""", "volume_ratio_5_20 volume_z_20 obv_flow_5 mfi_14", 5)
def _(t):
    return technical.volume(panel(t)).select("code", "trade_date", "volume_ratio_5_20", "volume_z_20", "obv_flow_5", "mfi_14")


@query("t13_t14_liquidity", f"""WITH {RETURNS}, a AS (SELECT *, abs(return_1) / nullif(amount / nullif({roll_sql('median', 'amount', 60, 20)}, 0), 0) AS ill FROM returns)
 SELECT code, trade_date, {roll_sql('avg', 'amount', 5)} / {roll_sql('avg', 'amount', 20)} AS amount_ratio_5_20, {roll_sql('avg', 'ill', 20)} AS amihud_20, {roll_sql('sum', 'CASE WHEN return_1 IS NOT NULL THEN CASE WHEN return_1 > 0 THEN volume ELSE 0 END END', 20)} / nullif({roll_sql('sum', 'volume', 20)}, 0) AS up_volume_ratio_20 FROM a""", "amount_ratio_5_20 amihud_20 up_volume_ratio_20")
def _(t):
    return technical.liquidity(technical.volume(technical.momentum(panel(t)))).select("code", "trade_date", "amount_ratio_5_20", "amihud_20", "up_volume_ratio_20")


@query("t15_turnover", f"""WITH {PANEL}, a AS (SELECT *, volume / 1000 AS rate, list(volume / 1000) OVER ({WC} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS l FROM panel)
 SELECT code, trade_date, CASE WHEN len(l) >= 20 THEN len(list_filter(l, lambda v: v <= rate)) / len(l) END AS turnover_percentile_60, rate / nullif(lag(rate, 5) OVER ({WC}), 0) - 1 AS turnover_change_5 FROM a""", "turnover_percentile_60 turnover_change_5")
def _(t):
    return technical.turnover(panel(t).withColumn("turnover_rate", F.col("volume") / 1000)).select("code", "trade_date", "turnover_percentile_60", "turnover_change_5")


def label_sql(h: int) -> str:
    return f"""SELECT code, trade_date, {h} AS horizon, entry_date, lead(trade_date, {h}) OVER c AS exit_date, sigma, entry, lead(close, {h}) OVER c AS exit, max(high) OVER (c ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS top, min(low) OVER (c ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS bottom FROM s WINDOW c AS ({WC})"""


LABELS = f"""{PANEL}, bench AS (SELECT trade_date, avg(open) AS open, avg(close) AS close FROM panel GROUP BY 1),
 r AS (SELECT *, close / lag(close) OVER ({WC}) - 1 AS r1 FROM panel), s AS (SELECT *, CASE WHEN count(r1) OVER v >= 5 THEN coalesce(stddev_samp(r1) OVER v, 0) ELSE 0 END AS sigma, lead(trade_date) OVER ({WC}) AS entry_date, lead(open) OVER ({WC}) AS entry FROM r WINDOW v AS ({WC} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 h AS ({' UNION ALL '.join(label_sql(h) for h in lab.HORIZONS)}),
 labels_of AS (SELECT code, h.trade_date, horizon, entry_date, exit_date, exit / entry - 1 AS ret, exit / entry - 1 - (b.close / a.open - 1) AS excess, greatest(0.002, 0.25 * sigma * sqrt(horizon)) AS threshold, greatest(top / entry - 1, 0) AS mfe, least(bottom / entry - 1, 0) AS mae
  FROM h JOIN bench a ON a.trade_date = entry_date JOIN bench b ON b.trade_date = exit_date WHERE exit IS NOT NULL AND entry > 0),
 labelled AS (SELECT *, CASE WHEN excess > threshold THEN 'up' WHEN excess < -threshold THEN 'down' ELSE 'flat' END AS label FROM labels_of)"""


def labelled(t):
    p = panel(t)
    b = p.groupBy("trade_date").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))
    return lab.forward_labels(p, b)


@query("labels_forward", f"WITH {LABELS} SELECT code, trade_date, horizon, entry_date, exit_date, ret, excess, threshold, label, mfe, mae FROM labelled", "ret excess threshold mfe mae")
def _(t):
    return labelled(t).select("code", "trade_date", "horizon", "entry_date", "exit_date", "ret", "excess", "threshold", "label", "mfe", "mae")


DETECTED = f"""ma AS (SELECT code, trade_date, {roll_sql('avg', 'close', 5)} AS sma_5, {roll_sql('avg', 'close', 20)} AS sma_20 FROM panel), x AS (SELECT *, lag(sma_5) OVER ({WC}) AS l5, lag(sma_20) OVER ({WC}) AS l20 FROM ma),
 detected AS (SELECT code, trade_date, 'ma_golden_cross_5_20' AS event FROM x WHERE sma_5 > sma_20 AND l5 <= l20 UNION ALL SELECT code, trade_date, 'ma_death_cross_5_20' FROM x WHERE sma_5 < sma_20 AND l5 >= l20)"""


def detected(t):
    return ev.detect(technical.trend(panel(t)), "m", ("ma_golden_cross_5_20", "ma_death_cross_5_20"))


@query("events_detected", f"WITH {PANEL}, {DETECTED} SELECT code, trade_date, event, substr(sha256('m|' || code || '|' || trade_date || '|' || event), 1, 20) AS event_id FROM detected")
def _(t):
    return detected(t).select("code", "trade_date", "event", "event_id")


CONDITIONS = {
    "macd_golden_cross": "macd_cross = 1 OR (l_dif <= l_dea AND macd_dif > macd_dea)",
    "macd_death_cross": "macd_cross = -1 OR (l_dif >= l_dea AND macd_dif < macd_dea)",
    "macd_zero_cross_up": "l_dif <= 0 AND macd_dif > 0",
    "macd_zero_cross_down": "l_dif >= 0 AND macd_dif < 0",
    "macd_hist_reversal_up": "l_slope <= 0 AND macd_hist_slope > 0",
    "macd_hist_reversal_down": "l_slope >= 0 AND macd_hist_slope < 0",
    "macd_hist_sign_up": "l_hist <= 0 AND macd_hist > 0",
    "macd_hist_sign_down": "l_hist >= 0 AND macd_hist < 0",
    "ma_golden_cross_5_20": "l5 <= l20 AND sma_5 > sma_20",
    "ma_death_cross_5_20": "l5 >= l20 AND sma_5 < sma_20",
    "price_breakout_20": "n20 >= 3 AND close > top20",
    "price_breakdown_20": "n20 >= 3 AND close < low20",
    "rsi_oversold_exit": "l_rsi < 30 AND rsi_14 >= 30",
    "rsi_overbought_exit": "l_rsi > 70 AND rsi_14 <= 70",
    "adx_trend_strengthening": "l_adx < 25 AND adx_14 >= 25",
    "adx_trend_weakening": "l_adx >= 25 AND adx_14 < 25",
    "bollinger_breakout_up": "close > sma_20 + 2 * sd20",
    "bollinger_breakout_down": "close < sma_20 - 2 * sd20",
    "bollinger_squeeze": "width <= q_now AND l_width > q_before",
    "macd_bearish_divergence": "ret5 > 0.03 AND dif5 < 0",
    "macd_bullish_divergence": "ret5 < -0.03 AND dif5 > 0",
    "flow_price_confirmation_up": "ret > 0 AND flow > 0",
    "flow_price_confirmation_down": "ret < 0 AND flow < 0",
    "flow_price_divergence_bearish": "ret > 0 AND flow < 0",
    "flow_price_divergence_bullish": "ret < 0 AND flow > 0",
    "industry_breadth_reversal_up": "l_breadth < 0.4 AND breadth >= 0.5",
    "industry_breadth_reversal_down": "l_breadth > 0.6 AND breadth <= 0.5",
} | {s: f"stage = '{s}' AND stage IS DISTINCT FROM l_stage" for s in ev.STAGES}
EVENTS = f"""{TECH}, {MEMBERS}, eb AS (SELECT p.*, industry, close / nullif(lag(close) OVER w, 0) - 1 AS ret, close / nullif(lag(close, 5) OVER w, 0) - 1 AS ret5, {roll_sql('avg', 'close', 5)} AS sma_5, {roll_sql('avg', 'close', 20)} AS sma_20, {roll_sql('stddev_pop', 'close', 20)} AS sd20, {roll_sql('avg', 'volume', 5)} / nullif({roll_sql('avg', 'volume', 20)}, 0) AS ratio, CASE WHEN volume % 2 = 0 THEN amount ELSE -amount END AS flow FROM panel p JOIN members USING (code) WINDOW w AS ({WC})),
 ec AS (SELECT eb.*, macd_dif, macd_dea, macd_hist, macd_hist_slope, macd_cross, rsi_14, adx_14, 4 * sd20 / nullif(sma_20, 0) AS width, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) OVER (PARTITION BY trade_date, industry) AS breadth,
  CASE WHEN ret > 0.005 AND ratio > 1.05 THEN 'volume_price_rise_confirmed' WHEN ret > 0.005 AND ratio < 0.95 THEN 'volume_price_rise_divergent' WHEN ret < -0.005 AND ratio > 1.05 THEN 'volume_price_fall_confirmed' WHEN ret < -0.005 AND ratio < 0.95 THEN 'volume_price_fall_exhausting' WHEN NOT coalesce(abs(ret) > 0.005, false) AND ratio > 1.05 THEN 'volume_expansion_flat_price' WHEN NOT coalesce(abs(ret) > 0.005, false) AND ratio < 0.95 THEN 'volume_contraction_flat_price' ELSE 'volume_price_neutral' END AS stage FROM eb JOIN tech_state USING (code, trade_date)),
 ed AS (SELECT *, lag(macd_dif) OVER w AS l_dif, lag(macd_dea) OVER w AS l_dea, lag(macd_hist) OVER w AS l_hist, lag(macd_hist_slope) OVER w AS l_slope, lag(sma_5) OVER w AS l5, lag(sma_20) OVER w AS l20, lag(rsi_14) OVER w AS l_rsi, lag(adx_14) OVER w AS l_adx, lag(width) OVER w AS l_width, lag(breadth) OVER w AS l_breadth, lag(stage) OVER w AS l_stage, macd_dif - lag(macd_dif, 5) OVER w AS dif5,
  count(close) OVER p AS n20, max(close) OVER p AS top20, min(close) OVER p AS low20, CASE WHEN count(width) OVER a >= 3 THEN quantile_cont(width, 0.2) OVER a END AS q_now, CASE WHEN count(width) OVER b >= 3 THEN quantile_cont(width, 0.2) OVER b END AS q_before FROM ec
  WINDOW w AS ({WC}), p AS ({WC} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), a AS ({WC} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), b AS ({WC} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
 every_event AS ({' UNION ALL '.join(f"SELECT code, trade_date, industry, '{k}' AS event, '{ev.direction(k)}' AS direction FROM ed WHERE {c}" for k, c in CONDITIONS.items())})"""


def event_panel(t):
    """The panel with its indicators and the breadth of industries. Rows are narrow when they pass through Python, all else is added where they lie by code; the breadth
    is a row a date and industry and is broadcast."""
    narrow = universe(t).select("code", "trade_date", "industry", "high", "low", "close", "volume", "amount")
    d = technical.macd_state(technical.recursive(narrow)).withColumn("return_1", roll.change("close"))
    d = technical.volume(technical.bollinger(technical.trend(d)))
    up = F.coalesce((F.col("return_1") > 0).cast("double"), F.lit(0.0))
    breadth = with_returns(t).groupBy("trade_date", "industry").agg(F.avg(up).alias("industry_breadth"))
    return d.withColumn("flow_net_large", F.when(F.col("volume") % 2 == 0, F.col("amount")).otherwise(-F.col("amount"))).join(F.broadcast(breadth), ["trade_date", "industry"])


@query("events_all_masks", f"WITH RECURSIVE {EVENTS} SELECT event, direction, code, trade_date, industry, substr(sha256('m|' || code || '|' || trade_date || '|' || event), 1, 20) AS event_id FROM every_event")
def _(t):
    return ev.detect(event_panel(t), "m").select("event", "direction", "code", "trade_date", "industry", "event_id")


@query("a13_j13_event_study", f"""WITH {LABELS}, {DETECTED}, base AS (SELECT horizon, avg(CAST(label = 'up' AS INTEGER)) AS base_up FROM labelled GROUP BY 1)
 SELECT event, horizon, count(*) AS n, avg(CAST(label = 'up' AS INTEGER)) AS up_rate, avg(excess) AS mean, median(excess) AS median, quantile_cont(excess, 0.9) AS q90, avg(mfe) AS mfe, avg(mae) AS mae, avg(CAST(label = 'up' AS INTEGER)) - any_value(base_up) AS lift FROM detected JOIN labelled USING (code, trade_date) JOIN base USING (horizon) GROUP BY 1, 2""", "up_rate mean median q90 mfe mae lift")
def _(t):
    return ev.event_study(detected(t), labelled(t), ["code", "trade_date"], 30, 0.002).select("event", "horizon", "n", "up_rate", "mean", "median", "q90", "mfe", "mae", "lift")


@query("a14_bootstrap_interval")
def _(t):
    return ev.bootstrap_interval(detected(t).join(labelled(t), ["code", "trade_date"]), ["event", "horizon"], "excess")


@query("g1_g2_regime_scores", f"""WITH {MARKET}, z AS (SELECT trade_date, (breadth - 0.5) * 2 AS trend, CASE WHEN n >= 10 THEN ret * 2 END AS momentum FROM market),
 s AS (SELECT trade_date, (coalesce(trend, 0) * 0.6 + coalesce(momentum, 0) * -0.4) / (0.6 + CASE WHEN momentum IS NULL THEN 0 ELSE 0.4 END) AS score FROM z)
 SELECT trade_date, score, CASE WHEN score >= 0.35 THEN 'risk_on' WHEN score <= -0.35 THEN 'risk_off' ELSE 'neutral' END AS state FROM s""", "score")
def _(t):
    z = market(t).select("trade_date", ((F.col("breadth") - 0.5) * 2).alias("trend"), F.when(F.col("n") >= 10, F.col("ret") * 2).alias("momentum"))
    d = z.withColumn("score", regime.dimension_score([("trend", 0.6), ("momentum", -0.4)]))
    return d.select("trade_date", "score", regime.three_way("score", "risk_on", "neutral", "risk_off", 0.35).alias("state"))


HYSTERESIS = f"""{ROBUST}, hc AS (SELECT scope, m, row_number() OVER (PARTITION BY scope ORDER BY m) AS i, CASE WHEN z IS NULL THEN 'unknown' WHEN z >= 0.5 THEN 'high' WHEN z <= -0.5 THEN 'low' ELSE 'normal' END AS candidate FROM robust),
 hr AS (SELECT scope, m, i, candidate, CASE WHEN candidate <> 'unknown' THEN candidate END AS state, NULL::VARCHAR AS pending, 0 AS n, 0 AS k FROM hc WHERE i = 1
  UNION ALL SELECT c.scope, c.m, c.i, c.candidate, CASE WHEN c.candidate = 'unknown' THEN r.state WHEN r.state IS NULL OR c.candidate = r.state THEN coalesce(r.state, c.candidate) WHEN CASE WHEN c.candidate = r.pending THEN r.n + 1 ELSE 1 END >= 2 THEN c.candidate ELSE r.state END,
   CASE WHEN c.candidate = 'unknown' THEN r.pending WHEN r.state IS NULL OR c.candidate = r.state OR CASE WHEN c.candidate = r.pending THEN r.n + 1 ELSE 1 END >= 2 THEN NULL ELSE c.candidate END,
   CASE WHEN c.candidate = 'unknown' THEN r.n WHEN r.state IS NULL OR c.candidate = r.state OR CASE WHEN c.candidate = r.pending THEN r.n + 1 ELSE 1 END >= 2 THEN 0 ELSE CASE WHEN c.candidate = r.pending THEN r.n + 1 ELSE 1 END END, 0 FROM hr r JOIN hc c ON c.scope = r.scope AND c.i = r.i + 1)"""


@query("g3_hysteresis", f"WITH RECURSIVE {HYSTERESIS} SELECT scope, m, candidate, state FROM hr")
def _(t):
    d = monthly(t)
    c = roll.expanding_robust_z(d, "x", "z", ["scope"], "m").withColumn("candidate", regime.three_way("z", "high", "normal", "low", 0.5))
    return regime.hysteresis(c, "candidate", ["scope"], "m", 2).select("scope", "m", "candidate", "state")


@query("g4_market_regime", f"""WITH {PANEL}, a AS (SELECT code, trade_date, close, {roll_sql('avg', 'close', 200)} AS sma, close / lag(close, 60) OVER ({WC}) - 1 AS mom FROM panel)
 SELECT code, trade_date, CASE WHEN sma IS NULL OR mom IS NULL THEN 'unknown' WHEN close > sma AND mom > 0.05 THEN 'bull' WHEN close < sma AND mom < -0.05 THEN 'bear' ELSE 'sideways' END AS regime FROM a""")
def _(t):
    return regime.market_regime(panel(t), "close", ["code"], "trade_date").select("code", "trade_date", "regime")


@query("g5_scenes", f"""WITH {RETURNS}, m AS (SELECT trade_date, round(stddev_samp(return_1), 9) AS vol, avg(CASE WHEN return_1 > 0 THEN 1.0 ELSE 0 END) AS breadth FROM returns GROUP BY 1), q AS (SELECT *, quantile_cont(vol, 0.8) OVER (ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS q FROM m)
 SELECT trade_date, CASE WHEN q IS NULL THEN 'unknown' WHEN vol > q THEN 'stress' WHEN breadth > 0.5 THEN 'expansion' ELSE 'range' END AS scene FROM q""")
def _(t):
    above = F.coalesce((F.col("return_1") > 0).cast("double"), F.lit(0.0))
    m = with_returns(t).groupBy("trade_date").agg(F.round(F.stddev_samp("return_1"), 9).alias("vol"), F.avg(above).alias("breadth"))
    return regime.scenes(m, "trade_date", "vol", "breadth", 60, 0.8).select("trade_date", "scene")


@query("a24_regime_performance", f"""WITH {MARKET}, g AS (SELECT CASE WHEN breadth > 0.5 THEN 'wide' ELSE 'narrow' END AS regime, ret / 10000 AS ret FROM market WHERE ret IS NOT NULL) SELECT regime, count(*) AS n, avg(ret) AS mean, exp(sum(ln(1 + ret))) - 1 AS compounded FROM g GROUP BY 1""", "mean compounded")
def _(t):
    m = market(t).filter("ret is not null").withColumn("ret", F.col("ret") / 10000).withColumn("regime", F.when(F.col("breadth") > 0.5, "wide").otherwise("narrow"))
    return regime.regime_performance(m, "regime", "ret")


MONTH_END = f"{RETURNS}, f AS (SELECT code, trade_date, industry, account, close / lag(close, 20) OVER ({WC}) - 1 AS momentum, {roll_sql('stddev_samp', 'return_1', 20)} AS vol, {roll_sql('avg', 'amount', 20)} AS adv FROM returns), me AS (SELECT max(trade_date) AS trade_date FROM f GROUP BY substr(trade_date, 1, 6)), month_end AS (SELECT f.* FROM f JOIN me USING (trade_date))"
WEIGHTS = {"momentum": (0.5, 1), "vol": (0.3, -1), "adv": (0.2, 1)}


def month_end(t):
    d = with_returns(t).withColumn("momentum", roll.change("close", 20)).withColumn("vol", roll.std("return_1", 20)).withColumn("adv", roll.mean("amount", 20))
    date = F.date_format("l_shipdate", "yyyyMMdd")  # month ends come from the dates alone, so the panel is built once
    last = t.lineitem.groupBy(F.substring(date, 1, 6)).agg(F.max(date).alias("trade_date")).select("trade_date")
    return d.join(F.broadcast(last), "trade_date", "left_semi")  # a row a month


SCORED = f"""{MONTH_END}, l AS (SELECT code, trade_date, industry, account, factor, raw FROM month_end UNPIVOT INCLUDE NULLS (raw FOR factor IN (momentum, vol, adv))),
 q AS (SELECT trade_date, factor, quantile_cont(raw, 0.01) AS lo, quantile_cont(raw, 0.99) AS hi FROM l GROUP BY 1, 2), c AS (SELECT l.*, CASE WHEN raw IS NOT NULL THEN least(greatest(raw, lo), hi) END AS x, CASE factor WHEN 'momentum' THEN 0.5 WHEN 'vol' THEN 0.3 ELSE 0.2 END AS weight, CASE factor WHEN 'vol' THEN -1 ELSE 1 END AS sg FROM l JOIN q USING (trade_date, factor)),
 z AS (SELECT *, CASE WHEN x IS NOT NULL THEN CASE WHEN stddev_pop(x) OVER g > 0 THEN (x - avg(x) OVER g) / stddev_pop(x) OVER g ELSE 0 END END AS z FROM c WINDOW g AS (PARTITION BY trade_date, factor)),
 n AS (SELECT *, (z - avg(z) OVER (PARTITION BY trade_date, factor, industry)) * sg AS neutral FROM z),
 scored AS (SELECT code, trade_date, industry, account, coalesce(sum(neutral * weight) / nullif(sum(CASE WHEN neutral IS NOT NULL THEN weight END), 0), 0) AS score, coalesce(sum(CASE WHEN neutral IS NOT NULL THEN weight END), 0) AS coverage FROM n GROUP BY 1, 2, 3, 4)"""


def scored(t):
    d = month_end(t)
    s, _ = xsec.process_factors(d, ["trade_date", "account"], "code", "industry", WEIGHTS)
    return s


@query("k1_factor_pipeline", f"WITH {SCORED} SELECT code, trade_date, industry, score, coverage FROM scored", "score coverage")
def _(t):
    s, _ = xsec.process_factors(month_end(t), ["trade_date"], "code", "industry", WEIGHTS)
    return s.select("code", "trade_date", "industry", "score", "coverage")


@query("k4_factor_selection", f"WITH {SCORED} SELECT trade_date, code, pick FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY round(score, 6) DESC, code) AS pick FROM scored WHERE coverage >= 0.5) WHERE pick <= 10")
def _(t):
    s, _ = xsec.process_factors(month_end(t), ["trade_date"], "code", "industry", WEIGHTS)
    s = s.filter("coverage >= 0.5").withColumn("pick", F.row_number().over(W.partitionBy("trade_date").orderBy(F.round("score", 6).desc(), "code")))
    return s.filter("pick <= 10").select("trade_date", "code", F.col("pick").cast("long").alias("pick"))


@query("k5_low_price_fallback", f"WITH {PANEL} SELECT trade_date, code FROM (SELECT trade_date, code, row_number() OVER (PARTITION BY trade_date ORDER BY close, code) AS n FROM panel WHERE close > 0) WHERE n <= 5")
def _(t):
    return panel(t).filter("close > 0").withColumn("n", F.row_number().over(W.partitionBy("trade_date").orderBy("close", "code"))).filter("n <= 5").select("trade_date", "code")


@query("k8_capped_top_n", f"""WITH {UNIVERSE}, g AS (SELECT *, row_number() OVER (PARTITION BY trade_date, industry ORDER BY amount DESC, code) AS gi FROM universe), n AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY CAST(gi > 1 AS INTEGER), amount DESC, code) AS pick FROM g)
 SELECT trade_date, code, pick, CASE WHEN gi > 1 THEN 'refill' ELSE 'rank' END AS picked FROM n WHERE pick <= 12""")
def _(t):
    return xsec.select_with_cap(universe(t), ["trade_date"], "industry", "amount", "code", 12, 1).select("trade_date", "code", F.col("pick").cast("long").alias("pick"), "picked")


@query("k9_round_robin", f"""WITH {UNIVERSE}, r AS (SELECT *, row_number() OVER (PARTITION BY trade_date, industry ORDER BY volume DESC, code) AS i, max(volume) OVER (PARTITION BY trade_date, industry) AS l FROM universe)
 SELECT trade_date, code, pick FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY i, l DESC, industry, code) AS pick FROM r WHERE i <= 2) WHERE pick <= 8""")
def _(t):
    return xsec.round_robin(universe(t), ["trade_date"], "industry", "volume", "code", 2, 8).select("trade_date", "code", F.col("pick").cast("long").alias("pick"))


@query("k12_hash_quota", f"WITH {PANEL} SELECT code, trade_date FROM panel QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY md5(code || '|7'), code) <= 5")
def _(t):
    return xsec.hash_quota(panel(t), "trade_date", ["code"], 5, 7).select("trade_date", "code")


@query("a1_a2_industry_breadth", f"WITH {RETURNS} SELECT trade_date, industry, median(return_1) AS median, avg(CASE WHEN return_1 > 0 THEN 1.0 ELSE 0 END) AS breadth, count(*) AS n FROM returns GROUP BY 1, 2", "median breadth")
def _(t):
    return xsec.breadth(with_returns(t), "trade_date", "industry", "return_1")


@query("a4_latest_per_code", f"WITH {PANEL} SELECT code, trade_date, close FROM panel QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1", "close")
def _(t):
    return pit.keep_last(panel(t), ["code"], [F.col("trade_date")]).select("code", "trade_date", "close")


__all__ = ["members"]
