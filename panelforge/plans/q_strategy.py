"""Strategies, selection controls, regime policy and the cost-aware transition as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.operators import allocation, capacity, features, roll, strategy, xsec
from panelforge.plans.base import MEMBERS, PANEL, RETURNS, panel, query, with_returns
from panelforge.plans.q_panel import MARKET, MONTH_END, SCORED, WC, WEIGHTS, market, month_end, roll_sql, scored
from panelforge.plans.q_pit import rank_sql
from panelforge.sources.store import held

#: What the rule strategies read, from the analog panel: month ends, quality from volume, low volatility and liquidity as ranks.
RULED = f"""{RETURNS}, rb AS (SELECT trade_date, avg(close) AS benchmark_close FROM returns GROUP BY 1), rbs AS (SELECT *, CASE WHEN count(*) OVER w >= 200 THEN avg(benchmark_close) OVER w END AS benchmark_sma_200 FROM rb WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
 rf AS (SELECT code, trade_date, close / nullif(lag(close, 20) OVER ({WC}), 0) - 1 AS momentum_20, close / nullif(lag(close, 60) OVER ({WC}), 0) - 1 AS momentum_60, close / nullif(lag(close, 120) OVER ({WC}), 0) - 1 AS momentum_120, close / {roll_sql('avg', 'close', 200)} - 1 AS sma_distance_200, {roll_sql('stddev_samp', 'return_1', 20)} AS vol, {roll_sql('avg', 'amount', 20)} AS adv, volume AS quality_raw, close - 20 AS pe_ttm, high / low AS pb, high / low - 1.2 AS discount_premium FROM returns),
 rm AS (SELECT max(trade_date) AS trade_date FROM rf GROUP BY substr(trade_date, 1, 6)),
 ruled AS (SELECT rf.*, benchmark_close, benchmark_sma_200, {rank_sql('quality_raw', 'trade_date')} AS quality, 1 - {rank_sql('vol', 'trade_date')} AS low_volatility, {rank_sql('adv', 'trade_date')} AS liquidity FROM rf JOIN rm USING (trade_date) JOIN rbs USING (trade_date))"""


def ruled(t):
    d = with_returns(t)
    b = d.groupBy("trade_date").agg(F.avg("close").alias("benchmark_close"))
    over = W.orderBy("trade_date").rowsBetween(-199, 0)  # a table of dates
    b = b.withColumn("benchmark_sma_200", F.when(F.count("benchmark_close").over(over) >= 200, F.avg("benchmark_close").over(over)))
    d = d.select("code", "trade_date", *[roll.change("close", n).alias(f"momentum_{n}") for n in (20, 60, 120)], (F.col("close") / roll.mean("close", 200) - 1).alias("sma_distance_200"), roll.std("return_1", 20).alias("vol"), roll.mean("amount", 20).alias("adv"), F.col("volume").alias("quality_raw"), (F.col("close") - 20).alias("pe_ttm"), (F.col("high") / F.col("low")).alias("pb"), (F.col("high") / F.col("low") - 1.2).alias("discount_premium"))
    date = F.date_format("l_shipdate", "yyyyMMdd")
    last = t.lineitem.groupBy(F.substring(date, 1, 6)).agg(F.max(date).alias("trade_date")).select("trade_date")
    d = d.join(last, "trade_date", "left_semi").join(b, "trade_date")
    rank = lambda c: xsec.pct_rank(c, ["trade_date"])
    return d.withColumn("quality", rank("quality_raw")).withColumn("low_volatility", 1 - rank("vol")).withColumn("liquidity", rank("adv")).withColumn("tracking_error_20", F.col("vol"))


def available_sql(parts: dict[str, float]) -> str:
    top = " + ".join(f"coalesce({x} * {w}, 0)" for x, w in parts.items())
    there = " + ".join(f"CASE WHEN {x} IS NOT NULL THEN {w} ELSE 0 END" for x, w in parts.items())
    return f"({top}) / nullif({there}, 0)"


RANKED = ", ranked AS (SELECT *, " + ", ".join(f"{rank_sql(f'momentum_{n}', 'trade_date')} AS m{n}" for n in (20, 60, 120)) + f", {rank_sql('sma_distance_200', 'trade_date')} AS ms, 1 - {rank_sql('pe_pos', 'trade_date')} AS pe, 1 - {rank_sql('pb', 'trade_date')} AS pbr, 1 - {rank_sql('prem', 'trade_date')} AS dp, 1 - {rank_sql('vol', 'trade_date')} AS te FROM (SELECT *, CASE WHEN pe_ttm > 0 THEN pe_ttm END AS pe_pos, abs(discount_premium) AS prem FROM ruled))"
SLOW = available_sql({"m60": 1, "m120": 1})
PARTS = {"momentum_20": "m20", "momentum_60": "m60", "momentum_120": "m120", "slow_momentum": "slow", "quality": "quality", "low_volatility": "low_volatility", "liquidity": "liquidity", "value": "val", "trend": "trend", "long_trend": "long_trend", "product_quality": "product"}
MIXED = f", mixed AS (SELECT *, {SLOW} AS slow, {available_sql({'pe': 1, 'pbr': 1})} AS val, {available_sql({'m60': 1, 'm120': 1, 'ms': 1})} AS trend, {available_sql({'m120': 1, 'ms': 1})} AS long_trend, {available_sql({'dp': 1, 'te': 1})} AS product, avg(CASE WHEN momentum_60 > 0 THEN 1.0 ELSE 0 END) OVER d >= 0.5 AS v60, avg(CASE WHEN momentum_120 > 0 THEN 1.0 ELSE 0 END) OVER d >= 0.5 AS v120, avg(CASE WHEN sma_distance_200 > 0 THEN 1.0 ELSE 0 END) OVER d >= 0.5 AS vs FROM ranked WINDOW d AS (PARTITION BY trade_date))"


def rule_sql(spec: str) -> str:
    score = available_sql({PARTS[k]: w for k, w in strategy.RULES[spec].items()})
    eligible, exposure = "score IS NOT NULL", "1.0"
    if spec.startswith(("Q_TREND", "Q_TRACK")):
        votes = " + ".join(f"CAST({v} AS INTEGER)" for v in (("v120", "vs") if spec.endswith("02") else ("v60", "v120", "vs")))
        exposure = f"CASE WHEN {votes} >= 2 THEN 1.0 WHEN {votes} = 1 THEN 0.5 ELSE 0.0 END"
    elif spec.startswith("Q_DUAL"):
        eligible = "score IS NOT NULL AND coalesce(sma_distance_200 > 0, false)"
        exposure = f"CAST(bool_or({eligible}) OVER (PARTITION BY trade_date) AS INTEGER)"
    elif spec.startswith("A_REGIME"):
        exposure = "CASE WHEN benchmark_close < benchmark_sma_200 THEN 0.5 WHEN benchmark_sma_200 IS NOT NULL THEN 1.0 END"
    return f"SELECT '{spec}' AS spec, trade_date, code, score, {eligible} AS eligible, CAST({exposure} AS DOUBLE) AS risky_exposure FROM (SELECT *, {score} AS score FROM mixed)"


@query("k7_rule_strategies", f"WITH {RULED}{RANKED}{MIXED} " + " UNION ALL ".join(rule_sql(s) for s in strategy.RULES), "score risky_exposure")
def _(t):
    return strategy.rule_strategies(ruled(t), list(strategy.RULES)).select("spec", "trade_date", "code", "score", "eligible", "risky_exposure")


@query("k8_controls", f"""WITH {SCORED}, k8s AS (SELECT trade_date, code, industry, round(score, 6) AS score FROM scored), k8m AS (SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS before FROM (SELECT DISTINCT trade_date FROM k8s)),
 k8r AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code) AS place, CAST(row_number() OVER (PARTITION BY trade_date, industry ORDER BY score DESC, code) > 2 AS INTEGER) AS over FROM k8s),
 k8n AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY over, score DESC, code) AS n FROM k8r), k8h AS (SELECT m.trade_date, r.code, strptime(r.trade_date, '%Y%m%d') - INTERVAL 1 DAY * (CAST(r.code AS BIGINT) % 90) AS bought FROM k8r AS r JOIN k8m AS m ON m.before = r.trade_date WHERE r.place <= 12),
 k8j AS (SELECT n.*, h.code IS NOT NULL AND place <= 15 AND NOT date_diff('day', bought, strptime(n.trade_date, '%Y%m%d')) >= 60 AS kept FROM k8n AS n LEFT JOIN k8h AS h USING (trade_date, code))
 SELECT trade_date, code, place, CASE WHEN n <= 10 AND over = 0 THEN 'rank' WHEN n <= 10 THEN 'refill' ELSE 'buffer' END AS picked FROM k8j WHERE n <= 10 OR kept""")
def _(t):
    d = scored_by_date(t)
    dates = d.select("trade_date").distinct().withColumn("next", F.lead("trade_date").over(W.orderBy("trade_date")))
    place = F.row_number().over(W.partitionBy("trade_date").orderBy(F.desc("score"), "code"))
    bought = F.date_sub(F.to_date("trade_date", "yyyyMMdd"), (F.col("code").cast("long") % 90).cast("int"))
    held = d.withColumn("p", place).filter("p <= 12").join(dates, "trade_date").filter("next is not null").select(F.col("next").alias("trade_date"), "code", bought.alias("last_buy_date"))
    picked = strategy.select_with_controls(d.withColumn("date", F.to_date("trade_date", "yyyyMMdd")), held, ["trade_date"], 10, 0.2, 0.5, 60)
    return picked.select("trade_date", "code", F.col("place").cast("long").alias("place"), "picked")


def scored_by_date(t):
    s, _ = xsec.process_factors(month_end(t), ["trade_date"], "code", "industry", WEIGHTS)
    return s.select("trade_date", "code", "industry", F.round("score", 6).alias("score"))


DAILY = f"{MARKET}, bd AS (SELECT trade_date, ret / 100 AS ret FROM market WHERE ret IS NOT NULL), bs AS (SELECT trade_date, exp(sum(ln(1 + ret)) OVER w) - 1 AS momentum_20, stddev_pop(ret) OVER w * sqrt(252) AS volatility_20, count(*) OVER w AS n FROM bd WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), states AS (SELECT trade_date, momentum_20, volatility_20, CASE WHEN n < 20 THEN 'unknown' WHEN momentum_20 < -0.03 OR volatility_20 > 0.30 THEN 'risk_off' WHEN momentum_20 > 0.02 AND volatility_20 < 0.28 THEN 'risk_on' ELSE 'mixed' END AS state FROM bs)"


def states(t):
    return strategy.backtest_regime(market(t).filter("ret is not null").select("trade_date", (F.col("ret") / 100).alias("ret")), "ret", "trade_date")


@query("g7_backtest_regime", f"WITH {DAILY} SELECT trade_date, momentum_20, volatility_20, state FROM states", "momentum_20 volatility_20")
def _(t):
    return states(t).select("trade_date", "momentum_20", "volatility_20", "state")


@query("g6_regime_policy", f"""WITH {MONTH_END}, dd AS (SELECT DISTINCT trade_date FROM month_end), st AS (SELECT trade_date, CASE CAST(substr(trade_date, 5, 2) AS INTEGER) % 4 WHEN 0 THEN 'risk_on' WHEN 1 THEN 'mixed' WHEN 2 THEN 'risk_off' ELSE 'unknown' END AS state FROM dd),
 g6f AS (SELECT m.*, state, adv / 1e4 AS score, -vol AS calm FROM month_end m JOIN st USING (trade_date)), g6r AS (SELECT *, {rank_sql('momentum', 'trade_date')} AS up, {rank_sql('adv', 'trade_date')} AS good, {rank_sql('calm', 'trade_date')} AS low FROM g6f),
 g6w AS (SELECT *, coalesce(score, 0) AS base, CASE state WHEN 'risk_on' THEN 0.30 * up + 0.05 * good + 0.00 * low WHEN 'mixed' THEN 0.08 * up + 0.08 * good + 0.05 * low ELSE -0.35 * up + 0.15 * good + 0.25 * low END AS raw FROM g6r)
 SELECT trade_date, code, base + coalesce(raw, 0) * greatest(stddev_pop(base) OVER (PARTITION BY trade_date), 0.5) AS score FROM g6w""", "score")
def _(t):
    month = F.substring("trade_date", 5, 2).cast("int") % 4
    d = month_end(t).withColumn("state", F.when(month == 0, "risk_on").when(month == 1, "mixed").when(month == 2, "risk_off").otherwise("unknown")).withColumn("score", F.col("adv") / 1e4)
    return strategy.regime_policy(d, ["trade_date"], "state", "trend", ["momentum"], ["adv"], ["vol"]).select("trade_date", "code", "score")


@query("k6_live_signals", f"""WITH {SCORED}, k6g AS (SELECT s.trade_date, s.code, s.industry, score, coverage, adv, momentum FROM scored s JOIN month_end m USING (code, trade_date)), k6h AS (SELECT *, adv > 1e5 AND momentum IS NOT NULL AS hard, coverage >= 0.5 AS relaxed FROM k6g), k6c AS (SELECT *, bool_or(coalesce(hard, false)) OVER (PARTITION BY trade_date) AS any_hard FROM k6h),
 k6f AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY round(score, 6) DESC, code) AS pick FROM k6c WHERE CASE WHEN any_hard THEN coalesce(hard, false) ELSE relaxed END) SELECT trade_date, code, pick, CASE WHEN any_hard THEN 'hard' ELSE 'relaxed' END AS rule FROM k6f WHERE pick <= 8""")
def _(t):
    s, _ = xsec.process_factors(month_end(t), ["trade_date"], "code", "industry", WEIGHTS)
    d = s.join(month_end(t).select("trade_date", "code", "adv", "momentum"), ["trade_date", "code"])
    return strategy_signals(d)


@query("k6_live_selection", f"""WITH {MONTH_END}, a AS (SELECT *, CASE WHEN CAST(code AS BIGINT) % 10 = 7 THEN 'st ' || code ELSE code END AS name, adv > 2e5 AND momentum IS NOT NULL AS hard, coalesce(vol IS NOT NULL, false) AS relaxed FROM month_end),
 b AS (SELECT *, bool_or(coalesce(hard, false)) OVER (PARTITION BY trade_date) AS any_hard FROM a WHERE NOT upper(name) LIKE '%ST%'), c AS (SELECT *, CASE industry WHEN 'NATION_1' THEN 0.5 WHEN 'NATION_2' THEN -0.25 ELSE 0 END AS sector_sentiment, CASE WHEN any_hard THEN 'hard' ELSE 'relaxed' END AS rule FROM b WHERE CASE WHEN any_hard THEN coalesce(hard, false) ELSE relaxed END),
 l AS (SELECT code, trade_date, industry, factor, raw FROM (SELECT code, trade_date, industry, momentum, vol, adv, CAST(sector_sentiment AS DOUBLE) AS sector_sentiment FROM c) UNPIVOT INCLUDE NULLS (raw FOR factor IN (momentum, vol, adv, sector_sentiment))), q AS (SELECT trade_date, factor, quantile_cont(raw, 0.01) AS lo, quantile_cont(raw, 0.99) AS hi FROM l GROUP BY 1, 2),
 x AS (SELECT l.*, CASE WHEN raw IS NOT NULL THEN least(greatest(raw, lo), hi) END AS x, CASE factor WHEN 'momentum' THEN 0.5 WHEN 'vol' THEN 0.3 WHEN 'adv' THEN 0.2 ELSE 0.1 END AS weight, CASE factor WHEN 'vol' THEN -1 ELSE 1 END AS sg FROM l JOIN q USING (trade_date, factor)),
 z AS (SELECT *, CASE WHEN x IS NOT NULL THEN CASE WHEN stddev_pop(x) OVER g > 0 THEN (x - avg(x) OVER g) / stddev_pop(x) OVER g ELSE 0 END END AS z FROM x WINDOW g AS (PARTITION BY trade_date, factor)),
 n AS (SELECT *, (z - CASE WHEN factor = 'sector_sentiment' THEN 0 ELSE avg(z) OVER (PARTITION BY trade_date, factor, industry) END) * sg AS neutral FROM z),
 s AS (SELECT code, trade_date, industry, coalesce(sum(neutral * weight) / nullif(sum(CASE WHEN neutral IS NOT NULL THEN weight END), 0), 0) AS base, coalesce(sum(CASE WHEN neutral IS NOT NULL THEN weight END), 0) / 1.1 AS coverage FROM n GROUP BY 1, 2, 3),
 j AS (SELECT s.*, rule, momentum, adv, -vol AS calm, CAST(substr(trade_date, 5, 2) AS INTEGER) % 4 AS m FROM s JOIN c USING (code, trade_date) WHERE coverage >= 0.5), r AS (SELECT *, {rank_sql('momentum', 'trade_date')} AS up, {rank_sql('adv', 'trade_date')} AS good, {rank_sql('calm', 'trade_date')} AS low FROM j),
 w AS (SELECT *, CASE m WHEN 0 THEN 0.30 * up + 0.05 * good + 0.00 * low WHEN 1 THEN 0.08 * up + 0.08 * good + 0.05 * low ELSE -0.35 * up + 0.15 * good + 0.25 * low END AS raw FROM r), fin AS (SELECT *, base + coalesce(raw, 0) * greatest(stddev_pop(base) OVER (PARTITION BY trade_date), 0.5) AS score FROM w)
 SELECT trade_date, code, rule, base AS base_score, score, pick, CASE WHEN rule = 'relaxed' THEN 'hard_filters_empty_relaxed' END AS warning FROM (SELECT *, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY round(score, 6) DESC, code) AS INTEGER) AS pick FROM fin) AS y WHERE pick <= 8""", "base_score score", 5)
def _(t):
    month = F.substring("trade_date", 5, 2).cast("int") % 4
    state = F.when(month == 0, "risk_on").when(month == 1, "mixed").when(month == 2, "risk_off").otherwise("unknown")
    d = month_end(t).withColumn("state", state).withColumn("name", F.when(F.col("code").cast("long") % 10 == 7, F.concat(F.lit("st "), F.col("code"))).otherwise(F.col("code")))
    mood = d.filter(F.col("industry").isin("NATION_1", "NATION_2")).select("trade_date", "industry", F.when(F.col("industry") == "NATION_1", 0.5).otherwise(-0.25).alias("sentiment")).distinct()
    out = strategy.live_signals(d, ["trade_date"], WEIGHTS, (F.col("adv") > 2e5) & F.col("momentum").isNotNull(), F.col("vol").isNotNull(), "trend", "state", 8, mood, 0.1, momentum=("momentum",), quality=("adv",), risk=("vol",))
    return out.filter("selected").select("trade_date", "code", "rule", "base_score", "score", "pick", "warning")


def strategy_signals(d):
    from panelforge.operators.pit import filtered_or_relaxed

    f = filtered_or_relaxed(d, ["trade_date"], (F.col("adv") > 1e5) & F.col("momentum").isNotNull(), F.col("coverage") >= 0.5)
    n = F.row_number().over(W.partitionBy("trade_date").orderBy(F.round("score", 6).desc(), "code"))
    return f.withColumn("pick", n.cast("long")).filter("pick <= 8").select("trade_date", "code", "pick", "rule")


@query("k14_oos_portfolio")
def _(t):
    d = with_returns(t).withColumn("momentum", roll.change("close", 20)).withColumn("reversal", -roll.change("close", 5)).withColumn("y", F.lead("close", 5).over(roll.series()) / F.col("close") - 1)
    long = d.filter("y is not null").select("trade_date", "code", (F.col("y") / 100).alias("excess_return"), "momentum", "reversal").unpivot(["trade_date", "code", "excess_return"], ["momentum", "reversal"], "strategy", "score")
    return strategy.oos_portfolio(long.filter("score is not null"), "strategy", 5)


BOOK = f"""{SCORED}, cb AS (SELECT trade_date, code, round(score, 6) AS score, row_number() OVER (PARTITION BY trade_date ORDER BY round(score, 6) DESC, code) AS p FROM scored), cm AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS next FROM (SELECT DISTINCT trade_date FROM cb)),
 book AS (SELECT cb.trade_date, cb.code, cb.score, CASE WHEN cb.p <= 8 THEN 0.11 ELSE 0 END AS aim, CASE WHEN h.p <= 8 THEN 0.08 + 0.01 * (h.p % 5) ELSE 0 END AS cur, round(cb.score * 0.01, 6) AS expected, 15.0 + CAST(cb.code AS BIGINT) % 20 AS cost_bps, CAST(CAST(cb.code AS BIGINT) % 7 AS DOUBLE) * 3 AS uncertainty_bps, CAST(cb.code AS BIGINT) % 11 = 0 AS risk_exit FROM cb LEFT JOIN (SELECT next AS trade_date, code, p FROM cb JOIN cm USING (trade_date)) h USING (trade_date, code))"""


@query("p4_cost_aware_transition", f"""WITH {BOOK}, p4r AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code) AS rank FROM book), p4a AS (SELECT *, cur > 0 AND rank <= 10 AS stay FROM p4r), p4b AS (SELECT *, stay AND row_number() OVER (PARTITION BY trade_date, stay ORDER BY rank) <= 8 AS kept FROM p4a),
 p4c AS (SELECT *, aim > 0 AND NOT kept AS fresh, sum(CAST(kept AS INTEGER)) OVER (PARTITION BY trade_date) AS n_kept FROM p4b), p4d AS (SELECT *, kept OR (fresh AND row_number() OVER (PARTITION BY trade_date, fresh ORDER BY rank) <= 8 - n_kept) AS sel FROM p4c),
 p4e AS (SELECT *, kept AND aim <= 0 AS hold, CASE WHEN kept AND aim <= 0 THEN cur WHEN sel THEN aim ELSE 0 END AS want, coalesce(max(CASE WHEN sel THEN expected END) OVER (PARTITION BY trade_date), 0) AS best FROM p4d WHERE sel OR cur > 0),
 p4f AS (SELECT *, CASE WHEN want - cur >= 0 THEN greatest(expected, 0) ELSE greatest(best - expected, -expected, 0) END * 10000 AS edge FROM p4e), p4g AS (SELECT *, edge - cost_bps * 1.2 - uncertainty_bps AS net FROM p4f),
 p4h AS (SELECT *, CASE WHEN risk_exit AND cur > 0 THEN 'hard_risk_exit' WHEN hold THEN 'rank_buffer_hold' WHEN abs(want - cur) < 0.005 THEN 'target_change_below_band' WHEN net <= 0 THEN 'insufficient_net_edge' ELSE '' END AS reason FROM p4g), p4i AS (SELECT *, CASE reason WHEN 'hard_risk_exit' THEN -cur WHEN '' THEN (want - cur) * 0.5 ELSE 0 END AS move FROM p4h),
 p4j AS (SELECT *, least(1, 0.15 / nullif(sum(CASE WHEN reason = '' THEN abs(move) ELSE 0 END) OVER (PARTITION BY trade_date), 0)) AS scale FROM p4i), p4k AS (SELECT *, greatest(cur + CASE WHEN reason = '' THEN move * coalesce(scale, 1) ELSE move END, 0) AS tgt FROM p4j),
 p4l AS (SELECT *, sum(tgt) OVER (PARTITION BY trade_date) - 0.75 AS over, CASE WHEN reason = 'hard_risk_exit' THEN 0 ELSE greatest(tgt - cur, 0) END AS buy FROM p4k), p4m AS (SELECT *, sum(buy) OVER (PARTITION BY trade_date) AS buys FROM p4l),
 p4n AS (SELECT *, greatest(CASE WHEN over > 1e-12 AND reason <> 'hard_risk_exit' THEN cur + buy * CASE WHEN buys > 1e-12 THEN greatest(1 - over / buys, 0) ELSE 0 END ELSE tgt END, 0) AS target FROM p4m)
 SELECT trade_date, code, target, net AS net_edge_bps, abs(target - cur) > 1e-12 AS changed, CASE WHEN abs(target - cur) > 1e-12 AND reason <> 'hard_risk_exit' THEN '' ELSE reason END AS reason FROM p4n""", "target net_edge_bps", 5)
def _(t):
    d = scored_by_date(t).withColumn("p", F.row_number().over(W.partitionBy("trade_date").orderBy(F.desc("score"), "code")))
    dates = d.select("trade_date").distinct().withColumn("next", F.lead("trade_date").over(W.orderBy("trade_date")))
    held = d.filter("p <= 8").join(dates, "trade_date").filter("next is not null").select(F.col("next").alias("trade_date"), "code", (0.08 + 0.01 * (F.col("p") % 5)).alias("current"))
    n = F.col("code").cast("long")
    book = d.join(held, ["trade_date", "code"], "left").select("trade_date", "code", "score", F.when(F.col("p") <= 8, 0.11).otherwise(0.0).alias("aim"), "current", F.round(F.col("score") * 0.01, 6).alias("expected"), (15.0 + n % 20).alias("cost_bps"), (n % 7 * 3.0).alias("uncertainty_bps"), (n % 11 == 0).alias("risk_exit"))
    out = strategy.cost_aware_transition(book, ["trade_date"], 8, 0.25, 0.005, 0.5, 0.15, 1.2, exposure=0.75)
    return out.select("trade_date", "code", "target", "net_edge_bps", "changed", "reason")


@query("p13_degenerate_scores", "SELECT event_type, count(*) AS n, count(DISTINCT round(floor(value / 20), 6)) AS n_unique, count(DISTINCT round(floor(value / 20), 6)) / count(*) AS unique_ratio FROM events WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT round(floor(value / 20), 6)) / count(*) < 0.2", "unique_ratio")
def _(t):
    return strategy.degenerate_scores(t.events.withColumn("score", F.floor(F.col("value") / 20).cast("double")), ["event_type"], "score", 0.2)


@query("w15_chart_metrics", f"""WITH {RETURNS}, n AS (SELECT *, close / nullif(lag(close, 20) OVER w, 0) - 1 AS m20, close / nullif(lag(close, 60) OVER w, 0) - 1 AS m60, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS i FROM returns WINDOW w AS ({WC}))
 SELECT code, max(CASE WHEN i = 1 THEN m20 END) AS momentum_20, max(CASE WHEN i = 1 THEN m60 END) AS momentum_60, stddev_samp(return_1) FILTER (WHERE i <= 60) AS volatility_60, avg(amount) FILTER (WHERE i <= 20) AS average_amount_20 FROM n GROUP BY 1""", "momentum_20 momentum_60 volatility_60 average_amount_20", 4)
def _(t):
    d = with_returns(t).withColumn("m20", roll.change("close", 20)).withColumn("m60", roll.change("close", 60))
    return roll.last_metrics(d, "m20", "m60", "return_1", "amount")


@query("p15_price_panels", f"""WITH {PANEL}, {MEMBERS}, top AS (SELECT code FROM panel GROUP BY 1 ORDER BY round(sum(amount), 2) DESC, code LIMIT 5) SELECT code, trade_date, open, high, low, close, volume FROM panel JOIN top USING (code) QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) <= 60""", "open high low close volume")
def _(t):
    p = panel(t)
    scores = p.groupBy("code").agg(F.round(F.sum("amount"), 2).alias("score"))
    return roll.candles(p, scores, 5, 60).select("code", "trade_date", "open", "high", "low", "close", "volume")


__all__ = ["scored"]


CAPACITY = f"""{MONTH_END}, mc AS (SELECT r.code, r.trade_date, r.account, r.close FROM returns AS r JOIN me USING (trade_date)), nx AS (SELECT code, trade_date, account, round(least(lead(close) OVER ({WC}) / close - 1, 1.0), 9) AS ret FROM mc),
 rk AS (SELECT 'momentum' AS strategy, account, trade_date, code, industry, round(momentum, 9) AS score FROM month_end UNION ALL SELECT 'calm', account, trade_date, code, industry, round(-vol, 9) FROM month_end),
 el AS (SELECT *, count(*) OVER (PARTITION BY strategy, account, trade_date) AS eligible FROM rk WHERE score IS NOT NULL), ki AS (SELECT *, row_number() OVER (PARTITION BY strategy, account, trade_date, industry ORDER BY score DESC, code) AS k FROM el),
 pk AS (SELECT *, row_number() OVER (PARTITION BY strategy, account, trade_date ORDER BY score DESC, code) AS pick FROM ki WHERE k <= 2), sl AS (SELECT pk.*, top_n, least(0.98 / top_n, 0.2) AS weight FROM pk, (SELECT unnest([2, 4, 6]) AS top_n) AS z WHERE pick <= top_n),
 dt AS (SELECT *, row_number() OVER (PARTITION BY strategy, account ORDER BY trade_date) AS i FROM (SELECT DISTINCT strategy, account, trade_date FROM rk) AS z), hd AS (SELECT sl.*, dt.i, coalesce(nx.ret, 0) AS r FROM sl JOIN dt USING (strategy, account, trade_date) LEFT JOIN nx USING (code, trade_date, account)),
 mv AS (SELECT strategy, account, top_n, i, sum(abs(w - b)) / 2 AS t FROM (SELECT strategy, account, top_n, code, i, sum(w) AS w, sum(b) AS b FROM (SELECT strategy, account, top_n, code, i, weight AS w, 0 AS b FROM hd UNION ALL SELECT strategy, account, top_n, code, i + 1, 0, weight FROM hd) AS y GROUP BY 1, 2, 3, 4, 5) AS z GROUP BY 1, 2, 3, 4),
 gr AS (SELECT strategy, account, top_n, i, sum(weight * r) AS g, max(eligible) AS e FROM hd GROUP BY 1, 2, 3, 4), nt AS (SELECT gr.*, t, g - t * 0.001 AS n FROM gr JOIN mv USING (strategy, account, top_n, i)),
 vl AS (SELECT *, exp(sum(ln(1 + greatest(n, -0.999999))) OVER (PARTITION BY strategy, account, top_n ORDER BY i)) AS v FROM nt), dr AS (SELECT *, v / greatest(max(v) OVER (PARTITION BY strategy, account, top_n ORDER BY i), 1) - 1 AS d FROM vl),
 st AS (SELECT strategy, account, top_n, count(*) AS dates, avg(e) AS average_eligible, avg(n) * 12 AS annual_return, stddev_samp(n) * sqrt(12) AS volatility, min(d) AS max_drawdown, avg(t) AS turnover FROM dr GROUP BY 1, 2, 3),
 pr AS (SELECT a.code AS a, b.code AS b FROM nx a JOIN nx b ON a.account = b.account AND a.trade_date = b.trade_date AND a.code < b.code WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 12 AND corr(a.ret, b.ret) >= 0.25),
 nd AS (SELECT DISTINCT strategy, account, top_n, code FROM sl), ed AS (SELECT x.strategy, x.account, x.top_n, x.code AS s, y.code AS t FROM (SELECT a, b FROM pr UNION SELECT b, a FROM pr) AS q JOIN nd x ON x.code = q.a JOIN nd y ON y.code = q.b AND y.strategy = x.strategy AND y.account = x.account AND y.top_n = x.top_n),
 re AS (SELECT strategy, account, top_n, code AS x, code AS y FROM nd UNION SELECT re.strategy, re.account, re.top_n, re.x, ed.t FROM re JOIN ed ON ed.strategy = re.strategy AND ed.account = re.account AND ed.top_n = re.top_n AND ed.s = re.y),
 cl AS (SELECT strategy, account, top_n, count(*) AS codes, count(DISTINCT c) AS clusters FROM (SELECT strategy, account, top_n, x, min(y) AS c FROM re GROUP BY 1, 2, 3, 4) AS z GROUP BY 1, 2, 3),
 al AS (SELECT st.*, annual_return / nullif(volatility, 0) AS sharpe, codes, clusters, average_eligible >= top_n + 1 AND max_drawdown >= -0.25 AS ok FROM st JOIN cl USING (strategy, account, top_n))"""


@query("p14_capacity_study", f"""WITH RECURSIVE {CAPACITY} SELECT strategy, account, top_n, dates, average_eligible, annual_return, volatility, max_drawdown, turnover, sharpe, codes, clusters,
 ok AND row_number() OVER (PARTITION BY strategy, account, ok ORDER BY coalesce(round(sharpe, 9), -999) DESC, clusters DESC, round(turnover, 9), top_n) = 1 AS recommended FROM al""", "average_eligible annual_return volatility max_drawdown turnover sharpe", 5)
def _(t):
    d = held(month_end(t).select("code", "trade_date", "account", "industry", "close", "momentum", "vol"), "month_ends")
    ret = F.round(F.least(F.lead("close").over(roll.series()) / F.col("close") - 1, F.lit(1.0)), 9)
    returns = d.select("code", "trade_date", "account", ret.alias("ret"))
    ranked = d.select("account", "trade_date", "code", "industry", F.explode(F.array(F.struct(F.lit("momentum").alias("strategy"), F.round("momentum", 9).alias("score")), F.struct(F.lit("calm").alias("strategy"), F.round(-F.col("vol"), 9).alias("score")))).alias("s")).select("s.*", "account", "trade_date", "code", "industry")
    own = capacity.ever_selected(returns, ranked, [2, 4, 6], ["strategy", "account"], "trade_date", "code", "industry", "score", max_per_index=2)
    pairs = allocation.covariances(allocation.pair_sums(own, "account", "code", "trade_date", "ret"), 12).filter("a < b").select("a", "b", "corr")
    return capacity.study(ranked, returns, pairs, [2, 4, 6], ["strategy", "account"], "trade_date", "code", "industry", "score", "ret", 12, max_per_index=2, least_corr=0.25)


VIEW_FEATURES = ["return_1", "momentum_20", "momentum_60", "realized_volatility_20", "drawdown_60", "pe_ttm"]
VIEW = f"""{RETURNS}, v AS (SELECT code, trade_date, industry, return_1, close / nullif(lag(close, 20) OVER ({WC}), 0) - 1 AS momentum_20, close / nullif(lag(close, 60) OVER ({WC}), 0) - 1 AS momentum_60, {roll_sql('stddev_samp', 'return_1', 20)} AS realized_volatility_20, close / max(close) OVER ({WC} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) - 1 AS drawdown_60, CASE WHEN volume > 30 THEN high END AS pe_ttm, CASE WHEN amount > 0 THEN ln(amount) END AS log_total_mv FROM returns)"""


@query("r7_feature_view", f"""WITH {VIEW}, k AS (SELECT *, {', '.join(f"{rank_sql(c, 'trade_date')} AS r_{c}" for c in [*VIEW_FEATURES, 'log_total_mv'])}, {', '.join(f"{rank_sql(c, 'trade_date, industry')} AS i_{c}" for c in ('momentum_20', 'momentum_60', 'realized_volatility_20', 'pe_ttm'))} FROM v),
 m AS (SELECT trade_date, avg(CASE WHEN return_1 IS NOT NULL THEN CAST(return_1 > 0 AS INTEGER) END) AS market_breadth_1, median(momentum_20) AS market_median_momentum_20, median(momentum_60) AS market_median_momentum_60, stddev_samp(return_1) AS market_cross_sectional_volatility_1, median(realized_volatility_20) AS market_median_realized_volatility_20, avg(CASE WHEN drawdown_60 IS NOT NULL THEN CAST(drawdown_60 < -0.1 AS INTEGER) END) AS market_drawdown_breadth_60 FROM v GROUP BY 1)
 SELECT code, trade_date, CAST(pe_ttm IS NULL AS INTEGER) * 1.0::DOUBLE AS pe_ttm_missing, {', '.join(f"r_{c} - avg(r_{c}) OVER (PARTITION BY trade_date) AS {c}_cs_rank" for c in [*VIEW_FEATURES, 'log_total_mv'])}, {', '.join(f"i_{c} - avg(i_{c}) OVER (PARTITION BY trade_date, industry) AS {c}_industry_rank" for c in ('momentum_20', 'momentum_60', 'realized_volatility_20', 'pe_ttm'))}, m.* EXCLUDE (trade_date) FROM k JOIN m USING (trade_date)""",
 " ".join([*(f"{c}_cs_rank" for c in [*VIEW_FEATURES, "log_total_mv"]), *(f"{c}_industry_rank" for c in ("momentum_20", "momentum_60", "realized_volatility_20", "pe_ttm")), "market_breadth_1", "market_median_momentum_20", "market_median_momentum_60", "market_cross_sectional_volatility_1", "market_median_realized_volatility_20", "market_drawdown_breadth_60"]))
def _(t):
    d = with_returns(t).withColumns({"momentum_20": roll.change("close", 20), "momentum_60": roll.change("close", 60), "realized_volatility_20": roll.std("return_1", 20), "drawdown_60": F.col("close") / F.max("close").over(roll.series().rowsBetween(-59, 0)) - 1, "pe_ttm": F.when(F.col("volume") > 30, F.col("high")), "total_mv": F.col("amount")})
    return features.feature_view(d.select("code", "trade_date", "industry", *VIEW_FEATURES, "total_mv"))


@query("m11_masked_sequences", f"""WITH {RETURNS}, q AS (SELECT code, trade_date, list(struct_pack(r := return_1, v := CASE WHEN volume > 30 THEN volume END)) OVER w AS s, count(*) OVER w AS n FROM returns WINDOW w AS ({WC} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
 x AS (SELECT code, trade_date, n, i, CASE WHEN i > 8 - n THEN s[i - (8 - n)] END AS e FROM q, (SELECT unnest(range(1, 9)) AS i) AS z WHERE n >= 5)
 SELECT code, trade_date, CAST(any_value(n) AS INTEGER) AS observed, sum(i * coalesce(e.v, 0)) AS weighted_v, CAST(sum(CASE WHEN i > 8 - n AND e.v IS NOT NULL THEN pow(2, i - 1) ELSE 0 END) AS BIGINT) AS valid_v, CAST(sum(CASE WHEN i > 8 - n AND e.r IS NOT NULL THEN pow(2, i - 1) ELSE 0 END) AS BIGINT) AS valid_r FROM x GROUP BY 1, 2""", "weighted_v")
def _(t):
    d = features.sequences(with_returns(t).withColumn("v", F.when(F.col("volume") > 30, F.col("volume"))).withColumnRenamed("return_1", "r"), ["r", "v"], 8, 5)
    total = lambda c, each: F.aggregate(F.transform(c, each), F.lit(0.0), lambda a, x: a + x)
    bits = lambda c: total(c, lambda x, i: x * F.pow(F.lit(2.0), i)).cast("long")
    return d.select("code", "trade_date", "observed", total("values.v", lambda x, i: x * (i + 1)).alias("weighted_v"), bits("valid.v").alias("valid_v"), bits("valid.r").alias("valid_r"))
