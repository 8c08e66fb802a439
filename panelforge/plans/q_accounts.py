"""Evaluation, performance, portfolio, document and streaming operators as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.scalar import cn_number, cn_percent, half_width, relocated, title_key, unique_place
from panelforge.operators import documents as docs
from panelforge.operators import evaluation as evalu
from panelforge.operators import performance as perf
from panelforge.operators import portfolio as port
from panelforge.operators import lineage, mentions, pit, xsec
from panelforge.plans.base import PANEL, RETURNS, panel, query, universe, with_returns
from panelforge.plans.q_panel import LABELS, MONTH_END, WC, WEIGHTS, labelled, month_end
from panelforge.plans.q_pit import rank_sql
from panelforge.streaming import ingest

SIGNAL = f"{PANEL}, s AS (SELECT code, trade_date, close / nullif(lag(close, 5) OVER ({WC}), 0) - 1 AS x, lead(close, 5) OVER ({WC}) / close - 1 AS y FROM panel)"


def signal(t):
    from panelforge.operators.roll import change, series

    return panel(t).select("code", "trade_date", change("close", 5).alias("x"), (F.lead("close", 5).over(series()) / F.col("close") - 1).alias("y"))


IC = f"{SIGNAL}, v AS (SELECT * FROM s WHERE x IS NOT NULL AND y IS NOT NULL), k AS (SELECT trade_date, {rank_sql('x', 'trade_date')} AS a, {rank_sql('y', 'trade_date')} AS b FROM v), ic AS (SELECT trade_date, count(*) AS n, corr(a, b) AS ic FROM k GROUP BY 1 HAVING count(*) >= 3 AND min(a) < max(a) AND min(b) < max(b))"


@query("a10_daily_ic", f"WITH {IC} SELECT trade_date, n, ic FROM ic", "ic")
def _(t):
    return evalu.daily_ic(signal(t), ["trade_date"], "x", "y")


@query("a11_a30_ic_summary", f"WITH {IC}, l AS (SELECT substr(trade_date, 1, 4) AS year, round(ic, 9) AS ic, lag(ic) OVER (PARTITION BY substr(trade_date, 1, 4) ORDER BY trade_date) AS l FROM ic) SELECT year, count(*) AS days, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS positive, avg(ic) / stddev_samp(ic) AS icir FROM l GROUP BY 1", "mean_ic std_ic positive icir")
def _(t):
    ic = evalu.daily_ic(signal(t), ["trade_date"], "x", "y").withColumn("year", F.substring("trade_date", 1, 4)).withColumn("ic", F.round("ic", 9))
    return evalu.ic_summary(ic, ["year"], "trade_date").select("year", "days", "mean_ic", "std_ic", "positive", "icir")


@query("a30_long_short_spread", f"""WITH {SIGNAL}, v AS (SELECT *, floor(count(*) OVER (PARTITION BY trade_date) * 0.2) AS k, row_number() OVER (PARTITION BY trade_date ORDER BY x DESC, code) AS top, row_number() OVER (PARTITION BY trade_date ORDER BY x, code DESC) AS low FROM s WHERE x IS NOT NULL AND y IS NOT NULL)
 SELECT trade_date, avg(y) FILTER (WHERE top <= k) - avg(y) FILTER (WHERE low <= k) AS spread FROM v GROUP BY 1""", "spread")
def _(t):
    return evalu.long_short(signal(t).filter("x is not null and y is not null"), ["trade_date"], "x", "y", "code")


@query("a12_factor_coverage", f"""WITH {MONTH_END}, l AS (SELECT trade_date, feature, value FROM month_end UNPIVOT INCLUDE NULLS (value FOR feature IN (momentum, vol, adv)))
 SELECT trade_date, feature, count(*) AS rows, count(*) - count(value) AS missing, count(value) / count(*) AS coverage, avg(value) AS mean, quantile_cont(value, 0.05) AS p5, median(value) AS p50, quantile_cont(value, 0.95) AS p95 FROM l GROUP BY 1, 2""", "coverage mean p5 p50 p95")
def _(t):
    return evalu.coverage(month_end(t), ["trade_date"], list(WEIGHTS)).drop("std")


PROBS = "p AS (SELECT o_orderpriority AS k, CASE WHEN o_totalprice > 250000 THEN 'up' WHEN o_totalprice < 100000 THEN 'down' ELSE 'flat' END AS label, (o_orderkey % 97) / 200.0 AS up, (o_orderkey % 89) / 200.0 AS down, 1 - (o_orderkey % 97) / 200.0 - (o_orderkey % 89) / 200.0 AS flat FROM orders)"


def probs(t):
    a, b = (F.col("o_orderkey") % 97) / 200.0, (F.col("o_orderkey") % 89) / 200.0
    label = F.when(F.col("o_totalprice") > 250000, "up").when(F.col("o_totalprice") < 100000, "down").otherwise("flat")
    return t.orders.select(F.col("o_orderpriority").alias("k"), label.alias("label"), a.alias("up"), b.alias("down"), (1 - a - b).alias("flat"))


@query("a26_prediction_accuracy", f"""WITH {PROBS} SELECT k, count(*) AS n, avg(CAST(CASE WHEN up >= down AND up >= flat THEN 'up' WHEN down >= flat THEN 'down' ELSE 'flat' END = label AS INTEGER)) AS hit_rate,
 avg(power(up - CAST(label = 'up' AS INTEGER), 2) + power(down - CAST(label = 'down' AS INTEGER), 2) + power(flat - CAST(label = 'flat' AS INTEGER), 2)) AS brier FROM p GROUP BY 1""", "hit_rate brier")
def _(t):
    return evalu.prediction_accuracy(probs(t), {"up": "up", "down": "down", "flat": "flat"}, "label", ["k"])


@query("a27_a28_reliability", f"""WITH {PROBS}, b AS (SELECT CAST(least(floor(up * 10), 9) AS INTEGER) AS bin, up, CAST(label = 'up' AS INTEGER) AS y FROM p) SELECT bin, count(*) AS n, avg(up) AS predicted, avg(y) AS observed FROM b GROUP BY 1""", "predicted observed")
def _(t):
    return evalu.reliability(probs(t).withColumn("y", (F.col("label") == "up").cast("int")), [], "up", "y")


@query("a28_calibration_error", f"""WITH {PROBS}, b AS (SELECT k, least(floor(up * 10), 9) AS bin, avg(up) AS p, avg(CAST(label = 'up' AS INTEGER)) AS o, count(*) AS n FROM p GROUP BY 1, 2) SELECT k, sum(n * abs(p - o)) / sum(n) AS ece FROM b GROUP BY 1""", "ece")
def _(t):
    return evalu.calibration_error(evalu.reliability(probs(t).withColumn("y", (F.col("label") == "up").cast("int")), ["k"], "up", "y"), ["k"])


@query("a29_population_stability", """WITH x AS (SELECT l_returnflag AS k, l_shipdate < TIMESTAMP '1997-01-01' AS old, CAST(l_quantity > 10 AS INTEGER) + CAST(l_quantity > 25 AS INTEGER) + CAST(l_quantity > 40 AS INTEGER) AS bin FROM lineitem),
 c AS (SELECT k, bin, sum(CAST(old AS INTEGER)) * 1.0 / sum(sum(CAST(old AS INTEGER))) OVER (PARTITION BY k) AS e, sum(CAST(NOT old AS INTEGER)) * 1.0 / sum(sum(CAST(NOT old AS INTEGER))) OVER (PARTITION BY k) AS a FROM x GROUP BY 1, 2)
 SELECT k, sum((a - e) * ln(a / e)) AS psi FROM c GROUP BY 1""", "psi")
def _(t):
    l = t.lineitem.select(F.col("l_returnflag").alias("k"), "l_quantity", (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp")).alias("old"))
    return evalu.psi(l.filter("not old"), l.filter("old"), ["k"], "l_quantity", [10, 25, 40])


@query("a32_extraction_quality", """WITH r AS (SELECT DISTINCT l_orderkey AS d, l_returnflag AS kind FROM lineitem WHERE l_linestatus = 'O'), p AS (SELECT DISTINCT l_orderkey AS d, l_returnflag AS kind FROM lineitem WHERE l_quantity > 20),
 j AS (SELECT coalesce(r.kind, p.kind) AS kind, r.d IS NOT NULL AS hit, p.d IS NOT NULL AS said FROM r FULL JOIN p ON r.d = p.d AND r.kind = p.kind),
 c AS (SELECT kind, count(*) FILTER (WHERE hit AND said) AS tp, count(*) FILTER (WHERE NOT hit) AS fp, count(*) FILTER (WHERE NOT said) AS fn FROM j GROUP BY 1) SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c""", "precision recall")
def _(t):
    pick = lambda c: t.lineitem.filter(c).select(F.col("l_orderkey").alias("d"), F.col("l_returnflag").alias("kind"))
    return evalu.extraction_quality(pick("l_linestatus = 'O'"), pick("l_quantity > 20"), "d", "kind")


@query("a31_exact_quantiles", """WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
 SELECT event_type, avg(value) FILTER (WHERE i = (n + 1) // 2 OR i = (n + 2) // 2) AS median, max(value) FILTER (WHERE i = (95 * n + 99) // 100) AS p95, count(*) AS n FROM n GROUP BY 1""", "median p95")
def _(t):
    return docs.exact_quantiles(t.events, ["event_type"], "value")


@query("a31_latest_run", "SELECT event_type, user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    return pit.keep_last(t.events, ["event_type", "user_id"], [F.col("ts"), F.col("event_id")]).select("event_type", "user_id", "event_id", "value")


NAV = f"{PANEL}, b AS (SELECT trade_date, round(avg(close), 6) AS bench FROM panel GROUP BY 1), nav AS (SELECT code AS account, trade_date, close AS v, bench FROM panel JOIN b USING (trade_date))"


def nav(t):
    p = panel(t)
    bench = p.groupBy("trade_date").agg(F.round(F.avg("close"), 6).alias("bench"))  # a row a date
    return p.join(F.broadcast(bench), "trade_date").select(F.col("code").alias("account"), "trade_date", F.col("close").alias("v"), "bench")


@query("a15_a18_account_performance", f"""WITH {NAV}, r AS (SELECT *, v / nullif(lag(v) OVER w, 0) - 1 AS r, bench / nullif(lag(bench) OVER w, 0) - 1 AS br, v / max(v) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM nav WINDOW w AS (PARTITION BY account ORDER BY trade_date)),
 g AS (SELECT account, count(r) AS days, avg(r) * 252 AS annual_return, stddev_samp(r) * sqrt(252) AS volatility, stddev_pop(CASE WHEN r < 0 THEN r END) * sqrt(252) AS downside, arg_max(v, trade_date) / arg_min(v, trade_date) - 1 AS cumulative, min(dd) AS max_drawdown, arg_min(trade_date, {{'a': dd, 'b': trade_date}}) AS trough_date, avg(r - br) * 252 AS excess, stddev_samp(r - br) * sqrt(252) AS tracking_error FROM r GROUP BY 1)
 SELECT account, days, annual_return, volatility, downside, cumulative, max_drawdown, trough_date, annual_return / volatility AS sharpe, annual_return / downside AS sortino, excess / tracking_error AS information_ratio FROM g""", "annual_return volatility downside cumulative max_drawdown sharpe sortino information_ratio")
def _(t):
    return perf.account_performance(nav(t), "account", "trade_date", "v", "bench").select("account", "days", "annual_return", "volatility", "downside", "cumulative", "max_drawdown", "trough_date", "sharpe", "sortino", "information_ratio")


@query("a16_weekly_turnover", """WITH w AS (SELECT o_custkey AS account, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, round(sum(o_totalprice), 2) AS traded FROM orders GROUP BY 1, 2), n AS (SELECT o_custkey AS account, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS v FROM orders GROUP BY 1, 2),
 f AS (SELECT account, arg_min(v, d) AS first FROM n GROUP BY 1) SELECT w.account, week, traded, coalesce(n.v, first) AS base, traded / coalesce(n.v, first) AS turnover FROM w ASOF LEFT JOIN n ON w.account = n.account AND week >= n.d JOIN f ON f.account = w.account""", "turnover traded")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("account"), "o_orderdate", "o_totalprice")
    n = o.groupBy("account", F.to_date("o_orderdate").alias("o_orderdate")).agg(F.max("o_totalprice").alias("v"))
    return perf.weekly_turnover(o, n, "account", "o_orderdate", "o_totalprice", "v")


TRADES = """tr AS (SELECT l_partkey AS part, strftime(l_shipdate, '%Y%m%d') AS d, l_orderkey AS k, l_linenumber AS ln, l_suppkey AS sk, CASE l_returnflag WHEN 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS q, l_extendedprice / l_quantity AS price FROM lineitem),
 cum AS (SELECT *, sum(q) OVER (PARTITION BY part, side ORDER BY d, k, ln, sk, q, price ROWS UNBOUNDED PRECEDING) AS e FROM tr)"""


@query("a17_fifo_round_trips", f"""WITH {TRADES} SELECT b.part, sum(least(b.e, s.e) - greatest(b.e - b.q, s.e - s.q)) AS shares, sum((s.price - b.price) * (least(b.e, s.e) - greatest(b.e - b.q, s.e - s.q))) AS pnl FROM cum b JOIN cum s ON b.part = s.part AND b.side = 'buy' AND s.side = 'sell' AND least(b.e, s.e) > greatest(b.e - b.q, s.e - s.q) GROUP BY 1""", "shares pnl", 5)
def _(t):
    tr = t.lineitem.select(F.col("l_partkey").alias("part"), F.date_format("l_shipdate", "yyyyMMdd").alias("d"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_suppkey").alias("sk"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    m = perf.fifo_matches(tr, ["part"], ["d", "k", "ln", "sk", "q", "price"], "side", "q", "price", "d")
    return m.groupBy("part").agg(F.sum("shares").alias("shares"), F.sum("pnl").alias("pnl"))


@query("a25_contribution_concentration", "SELECT o_custkey, max(o_totalprice) / sum(o_totalprice) AS share, max(o_totalprice) / sum(o_totalprice) > 0.3 AS too_concentrated FROM orders GROUP BY 1", "share")
def _(t):
    return perf.concentration(t.orders, ["o_custkey"], "o_totalprice", 0.3)


@query("a33_allocations", "WITH g AS (SELECT c_nationkey, c_mktsegment, round(sum(c_acctbal), 2) AS v FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment, v / nullif(sum(v) OVER (PARTITION BY c_nationkey), 0) AS weight FROM g", "weight", 5)
def _(t):
    g = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    return perf.allocations(g, ["c_nationkey"], "c_mktsegment", "v").select("c_nationkey", "c_mktsegment", "weight")


@query("a34_book_overlap", """WITH a AS (SELECT l_suppkey AS k, l_partkey AS n, sum(l_quantity) AS w FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2), b AS (SELECT l_suppkey AS k, l_partkey AS n, sum(l_quantity) AS w FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
 j AS (SELECT coalesce(a.k, b.k) AS k, a.w AS x, b.w AS y FROM a FULL JOIN b ON a.k = b.k AND a.n = b.n) SELECT k, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) / count(*) AS jaccard, sum(least(coalesce(x, 0), coalesce(y, 0))) / sum(greatest(coalesce(x, 0), coalesce(y, 0))) AS weighted_overlap FROM j GROUP BY 1""", "jaccard weighted_overlap")
def _(t):
    a, b = (t.lineitem.filter(F.col("l_linestatus") == s).groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("n")).agg(F.sum("l_quantity").alias("w")) for s in "OF")
    return perf.overlap(a, b, ["k"], "n", "w")


@query("a35_nav_jumps", f"WITH {NAV}, m AS (SELECT account, trade_date, abs(v / lag(v) OVER (PARTITION BY account ORDER BY trade_date) - 1) AS move FROM nav) SELECT account, trade_date, move, CASE WHEN move >= 0.1 THEN 'critical' ELSE 'warn' END AS severity FROM m WHERE move >= 0.05", "move")
def _(t):
    return perf.nav_jumps(nav(t), "account", "trade_date", "v").select("account", "trade_date", "move", "severity")


@query("a36_attribution", """WITH e AS (SELECT o_custkey AS account, o_orderpriority AS factor, count(*) * 1.0 AS exposure FROM orders GROUP BY 1, 2), r AS (SELECT o_orderpriority AS factor, round(avg(o_totalprice) / 1e6, 9) AS fr FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
 SELECT account, coalesce(sum(0.5 * exposure * fr), 0) AS explained, coalesce(string_agg(CASE WHEN fr IS NULL THEN factor END, '|' ORDER BY factor), '') AS missing FROM e LEFT JOIN r USING (factor) GROUP BY 1""", "explained")
def _(t):
    e = t.orders.groupBy(F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("factor")).agg(F.count(F.lit(1)).cast("double").alias("exposure")).withColumn("weight", F.lit(0.5))
    r = t.orders.filter("o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("factor")).agg(F.round(F.avg("o_totalprice") / 1e6, 9).alias("factor_return"))
    return perf.attribution(e, r, ["account"], "factor")


@query("p9_w17_relative_wealth", f"WITH {NAV}, x AS (SELECT account, trade_date, (v / first_value(v) OVER w) / (bench / first_value(bench) OVER w) AS relative FROM nav WINDOW w AS (PARTITION BY account ORDER BY trade_date)) SELECT account, trade_date, relative, relative / max(relative) OVER (PARTITION BY account ORDER BY trade_date) - 1 AS relative_drawdown FROM x", "relative relative_drawdown")
def _(t):
    return perf.relative_wealth(nav(t), "account", "trade_date", "v", "bench").select("account", "trade_date", "relative", "relative_drawdown")


@query("w17_season_nav", f"""WITH {NAV}, a AS (SELECT account, coalesce(arg_max(v, trade_date) FILTER (WHERE trade_date <= '19970701'), arg_min(v, trade_date)) AS av, coalesce(arg_max(bench, trade_date) FILTER (WHERE trade_date <= '19970701'), arg_min(bench, trade_date)) AS ab FROM nav GROUP BY 1)
 SELECT account, trade_date, v / av - 1 AS ret, bench / ab - 1 AS benchmark_ret FROM nav JOIN a USING (account) WHERE trade_date >= '19970701'""", "ret benchmark_ret")
def _(t):
    return perf.season_nav(nav(t), "account", "trade_date", "v", "bench", "19970701").select("account", "trade_date", "ret", "benchmark_ret")


@query("p1_p2_fill_costs", """WITH i AS (SELECT *, least(greatest(2500 * l_discount * sqrt(l_extendedprice / 1e6), 5), 80) AS bps FROM lineitem), f AS (SELECT *, CASE l_returnflag WHEN 'R' THEN -1 ELSE 1 END AS sg FROM i),
 p AS (SELECT *, round(l_tax * 1000 * (1 + sg * bps / 10000) + 7.0000001, 4) AS price FROM f) SELECT l_returnflag, l_linestatus, count(*) AS n, sum(greatest(price * l_quantity * 0.0003, 5)) AS commission, sum(CASE WHEN sg < 0 THEN price * l_quantity * 0.001 ELSE 0 END) AS stamp FROM p GROUP BY 1, 2""", "commission stamp", 2)
def _(t):
    d = t.lineitem.withColumn("side", F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy")).withColumn("amount", F.lit(1e6))
    bps = port.impact_bps("l_extendedprice", "amount", "l_discount", 5.0, 80.0)
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    d = d.withColumn("bps", bps).withColumn("fill_price", F.round(F.col("l_tax") * 1000 * (1 + sign * F.col("bps") / 10000) + 7.0000001, 4)).withColumn("gross", F.col("fill_price") * F.col("l_quantity"))
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.col("gross") * 0.0003, F.lit(5.0))).alias("commission"), F.sum(F.when(F.col("side") == "sell", F.col("gross") * 0.001).otherwise(0.0)).alias("stamp"))


@query("p3_p7_trade_gate_and_lots", "SELECT o_orderkey, o_totalprice / 1000 > 40 * 1.5 + 20 * 0.5 AS trade, CAST(floor(o_totalprice / (25.5 * 100)) * 100 AS BIGINT) AS shares FROM orders")
def _(t):
    return t.orders.select("o_orderkey", port.worth_trading(F.col("o_totalprice") / 1000, F.lit(40), F.lit(20), 1.5, 0.5).alias("trade"), port.lot_shares("o_totalprice", F.lit(25.5), 100).cast("long").alias("shares"))


@query("p5_inverse_vol_weights", "WITH v AS (SELECT o_custkey, o_orderpriority AS code, stddev_samp(o_totalprice) AS vol FROM orders GROUP BY 1, 2), i AS (SELECT *, CASE WHEN vol > 0 THEN 1 / vol END AS inv FROM v) SELECT o_custkey, code, least(coalesce(inv / sum(inv) OVER (PARTITION BY o_custkey), 0), 0.4) AS weight FROM i", "weight")
def _(t):
    v = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("code")).agg(F.stddev_samp("o_totalprice").alias("vol"))
    return port.inverse_vol_weights(v, ["o_custkey"], "vol", 0.4).select("o_custkey", "code", "weight")


@query("p8_p10_account_replay")
def _(t):
    s, _ = xsec.process_factors(month_end(t), ["trade_date", "account"], "code", "industry", WEIGHTS)
    pick = s.withColumn("n", F.row_number().over(W.partitionBy("account", "trade_date").orderBy(F.desc("score"), "code"))).filter("n <= 5").select("account", "trade_date", "code", F.lit(0.18).alias("weight"))
    over = W.partitionBy("code").orderBy("trade_date").rowsBetween(-19, 0)
    smooth = universe(t).select("account", "trade_date", "code", F.avg("open").over(over).alias("open"), F.avg("close").over(over).alias("close"))  # prices of a day are unrelated parts; their averages move like prices
    return port.replay(smooth.join(pick, ["account", "trade_date", "code"], "left"), "account", 1e7)


@query("p12_settlement_queue")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("account"), F.date_format("o_orderdate", "yyyyMMdd").alias("trade_date"), F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"), F.col("o_totalprice").alias("value"))
    return port.settlement(o, "account", 5e5)


@query("p14_correlation_pairs", f"""WITH {RETURNS}, r AS (SELECT industry, trade_date, round(avg(return_1), 9) AS r FROM returns WHERE return_1 IS NOT NULL GROUP BY 1, 2) SELECT a.industry AS a, b.industry AS b, count(*) AS n, corr(a.r, b.r) AS corr FROM r a JOIN r b ON a.trade_date = b.trade_date AND a.industry < b.industry GROUP BY 1, 2 HAVING count(*) >= 20""", "corr")
def _(t):
    r = with_returns(t).filter("return_1 is not null").groupBy("industry", "trade_date").agg(F.round(F.avg("return_1"), 9).alias("r"))
    return port.correlation_pairs(r, "industry", "trade_date", "r", 20)


@query("m1_walk_forward_splits", f"""WITH {LABELS}, l AS (SELECT code, trade_date, exit_date FROM labelled WHERE horizon = 5), d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM (SELECT DISTINCT trade_date FROM l)), c AS (SELECT count(*) AS n, count(*) // 5 AS size FROM d),
 f AS (SELECT k AS fold, size * (k + 1) AS first, CASE WHEN k = 3 THEN n ELSE size * (k + 2) END AS last, (SELECT trade_date FROM d WHERE i = size * (k + 1)) AS start FROM c, (SELECT unnest([0, 1, 2, 3]) AS k))
 SELECT fold, role, count(*) AS n FROM (SELECT fold, CASE WHEN i >= first AND i < last THEN 'validation' WHEN i < first - 10 AND exit_date < start THEN 'train' END AS role FROM l JOIN d USING (trade_date), f) WHERE role IS NOT NULL GROUP BY 1, 2""")
def _(t):
    l = labelled(t).filter("horizon = 5").select("code", "trade_date", "exit_date")
    return evalu.walk_forward(l, "trade_date", "exit_date", 4, 10).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("m11_sequences", f"WITH {PANEL}, q AS (SELECT code, trade_date, list(close) OVER w AS s, count(*) OVER w AS n FROM panel WINDOW w AS ({WC} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT code, trade_date, list_aggregate(s, 'max') AS top, s[1] AS first FROM q WHERE n = 10", "top first")
def _(t):
    w = W.partitionBy("code").orderBy("trade_date").rowsBetween(-9, 0)
    d = panel(t).select("code", "trade_date", F.collect_list("close").over(w).alias("s")).filter(F.size("s") == 10)
    return d.select("code", "trade_date", F.array_max("s").alias("top"), F.col("s")[0].alias("first"))


@query("d1_d8_text_keys", "SELECT c_custkey, lower(regexp_replace(c_name || ': Notice, No. 7!', '[[:punct:][:space:]$+<=>^`|~]', '', 'g')) AS key, CASE WHEN instr(c_name, '1') > 0 AND instr(substr(c_name, instr(c_name, '1') + 1), '1') = 0 THEN CAST(instr(c_name, '1') - 1 AS INTEGER) ELSE -1 END AS place FROM customer")
def _(t):
    return t.customer.select("c_custkey", title_key(half_width(F.concat("c_name", F.lit("： Notice， No. 7！")))).alias("key"), F.coalesce(unique_place("c_name", F.lit("1")), F.lit(-1)).cast("int").alias("place"))


@query("d2_d3_fingerprint_dedupe", "SELECT min(doc_id) AS doc_id, sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS fingerprint, count(*) AS copies FROM documents GROUP BY 2")
def _(t):
    return t.documents.groupBy(docs.fingerprint("text").alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


RULES = [("insult", "idiot|moron|loser", -1), ("notice", "license", 0), ("number", "version [0-9]+", 1)]


@query("d4_rule_events", "SELECT doc_id, k AS event_type, CAST(d AS INTEGER) AS direction, m AS match, CAST(instr(text, m) AS INTEGER) AS at FROM (SELECT doc_id, text, k, d, regexp_extract(text, '(' || p || ')', 1, 'i') AS m FROM documents, (VALUES ('insult', -1, 'idiot|moron|loser'), ('notice', 0, 'license'), ('number', 1, 'version [0-9]+')) AS r(k, d, p)) WHERE m <> ''")
def _(t):
    return docs.extract_events(t.documents, RULES, "text", ["doc_id"]).select("doc_id", "event_type", "direction", "match", F.col("at").cast("int").alias("at"))


@query("d5_entities", "SELECT DISTINCT doc_id, w AS entity FROM (SELECT doc_id, unnest(string_split_regex(lower(substr(text, 1, 20000)), '[^\\p{L}\\p{N}]+')) AS w FROM documents) WHERE w IN ('the', 'und', 'les', 'que')")
def _(t):
    aliases = t.spark.createDataFrame([(w, w, 0.9) for w in ("the", "und", "les", "que")], "alias string, entity string, confidence double")
    return docs.resolve_words(t.documents, aliases, "doc_id", "text").select("doc_id", "entity")


ALIASES = [("the", "article", 0.9), (" of the ", "phrase", 1.0), ("ver", "part", 0.8), ("web", "site", 0.9), ("Th", "article", 1.0), ("x", "letter", 1.0)]


@query("d5_entity_substrings", "SELECT doc_id, e AS entity, max(c) AS confidence FROM (SELECT doc_id, coalesce(source, '') || chr(10) || coalesce(substr(text, 1, 20000), '') AS h FROM documents), (VALUES ('the', 'article', 0.9), (' of the ', 'phrase', 1.0), ('ver', 'part', 0.8), ('web', 'site', 0.9), ('Th', 'article', 1.0), ('x', 'letter', 1.0)) AS r(a, e, c) WHERE length(a) >= 2 AND contains(h, a) GROUP BY 1, 2")
def _(t):
    aliases = t.spark.createDataFrame([(a, "word", e, c) for a, e, c in ALIASES], "alias string, entity_type string, entity string, confidence double")
    return docs.resolve_entities(t.documents, aliases, "doc_id", "text", "source").select("doc_id", "entity", "confidence")


@query("d6_document_kind", "SELECT CASE WHEN regexp_matches(text, '^[A-Z !,.]+$') THEN 'capitals' WHEN regexp_matches(text, '[0-9]{10}') THEN 'numbers' WHEN regexp_matches(text, '\\|') THEN 'table' ELSE 'other' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(docs.title_kind("text", [("capitals", "^[A-Z !,.]+$"), ("numbers", "[0-9]{10}"), ("table", "\\|")]).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("d7_chinese_numbers", "SELECT o_orderkey, CAST(floor(o_totalprice) * 10000 AS DOUBLE) AS amount, CAST((o_orderkey % 500) AS DOUBLE) / 100 AS share FROM orders", "amount share")
def _(t):
    n = F.floor("o_totalprice").cast("string")
    return t.orders.select("o_orderkey", cn_number(F.concat(n, F.lit("万元"))).cast("double").alias("amount"), cn_percent(F.concat((F.col("o_orderkey") % 500).cast("string"), F.lit("%"))).alias("share"))


@query("d10_novelty")
def _(t):
    return docs.novelty(t.conversations.select("conv_id", "turn", F.col("text").alias("key")), ["conv_id"], "turn", "key").select("conv_id", "turn", "novelty")


@query("d14_d16_events_as_of", """SELECT event_id FROM events e WHERE ts <= TIMESTAMP '2024-01-20' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.ts <= TIMESTAMP '2024-01-20' AND x.event_type = 'refund' AND x.event_id - 1 = e.event_id) AND NOT EXISTS (SELECT 1 FROM events x WHERE x.ts <= TIMESTAMP '2024-01-20' AND x.event_type = 'view' AND x.event_id - 2 = e.event_id)""")
def _(t):
    e = t.events.select("event_id", F.col("ts").alias("first_seen"), "event_type")
    shift = F.when(F.col("event_type") == "refund", 1).when(F.col("event_type") == "view", 2)
    rel = e.filter("event_type in ('refund', 'view')").select((F.col("event_id") - shift).alias("event_id"), F.when(F.col("event_type") == "refund", "supersedes").otherwise("revises").alias("kind"), "first_seen")
    return docs.events_as_of(e, F.lit("2024-01-20").cast("timestamp"), rel).select("event_id")


@query("d15_decision_feed", """SELECT user_id, event_id, origin, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, origin, event_id) AS place FROM (SELECT user_id, event_id, value, 'canonical' AS origin FROM events WHERE event_type <> 'click' UNION ALL SELECT user_id, event_id, value, 'quarantine' FROM events WHERE event_type = 'click'))""")
def _(t):
    e = t.events.select("user_id", "event_id", "value", "event_type")
    both = docs.decision_feed({"canonical": e.filter("event_type <> 'click'"), "quarantine": e.filter("event_type = 'click'")}, "user_id", "value")
    return both.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "origin", "event_id")).cast("long")).select("user_id", "event_id", "origin", "place")


@query("d17_latest_within_ttl", """WITH l AS (SELECT user_id, event_type, ts, value FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-25') BETWEEN 0 AND 6 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) = 1)
 SELECT user_id, event_type, value * (1 - date_diff('day', CAST(ts AS DATE), DATE '2024-01-25') / 7.0) AS decayed FROM l""", "decayed")
def _(t):
    return docs.latest_within(t.events.select("user_id", "event_type", "ts", "value"), ["user_id", "event_type"], "ts", "2024-01-25", 6, "value").select("user_id", "event_type", "decayed")


@query("d20_lineage_append", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def _(t):
    return docs.append_lineage(t.orders.filter("o_orderstatus = 'F'"), t.orders.filter("o_orderstatus <> 'F'"), ["o_orderkey"]).select("o_orderkey")


EDGES = """e AS (SELECT 'r' || n_regionkey AS s, 'n' || n_nationkey AS t FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def edges(t):
    """Regions lead to nations, these to customers and back to regions (a cycle), customers to orders."""
    link = lambda d, a, x, b, y: d.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("s"), F.concat(F.lit(b), F.col(y).cast("string")).alias("t"))
    return link(t.nation, "r", "n_regionkey", "n", "n_nationkey").unionByName(link(t.customer, "n", "c_nationkey", "c", "c_custkey")).unionByName(link(t.orders, "c", "o_custkey", "o", "o_orderkey")).unionByName(link(t.nation, "n", "n_nationkey", "r", "n_regionkey"))


@query("d20_descendants", f"WITH RECURSIVE {EDGES}, r AS (SELECT DISTINCT s AS root, s AS node, 0 AS depth FROM e WHERE s LIKE 'r%' UNION SELECT r.root, e.t, r.depth + 1 FROM r JOIN e ON r.node = e.s WHERE r.depth < 6) SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2")
def _(t):
    return lineage.reached(edges(t), edges(t).filter("s like 'r%'").select("s").distinct(), "s", "t")


@query("d20_ancestors", f"WITH RECURSIVE {EDGES}, r AS (SELECT DISTINCT t AS root, t AS node, 0 AS depth FROM e WHERE t LIKE 'o%' UNION SELECT r.root, e.s, r.depth + 1 FROM r JOIN e ON r.node = e.t WHERE r.depth < 6) SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2")
def _(t):
    return lineage.reached(edges(t), edges(t).filter("t like 'o%'").select("t").distinct(), "t", "s")


@query("d20_conflicts", "SELECT l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_quantity, l_returnflag)) AS payloads FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT (l_partkey, l_quantity, l_returnflag)) > 1 AND bool_or(l_linestatus = 'O')")
def _(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"]
    part = lambda flag: t.lineitem.filter(F.col("l_linestatus") == flag).select(*cols)
    return lineage.conflicts(t.lineitem.filter("l_linestatus <> 'O'").select(*cols), part("O"), ["l_orderkey", "l_linenumber"])


@query("d8_relocated_quotes", """WITH d AS (SELECT doc_id, text, substr(text, 40, 30) AS q FROM documents WHERE length(text) >= 70), n AS (SELECT *, instr(text, q) AS p FROM d)
 SELECT doc_id, p - 1 + length(substr(text, 1, p - 1)) - length(replace(substr(text, 1, p - 1), chr(10), '')) AS start, p + 29 + length(substr(text, 1, p + 29)) - length(replace(substr(text, 1, p + 29), chr(10), '')) AS end,
 replace(q, chr(10), chr(13) || chr(10)) AS source FROM n WHERE instr(substr(text, p + 1), q) = 0""")
def _(t):
    """Quotes with full-width full stops, from texts whose line ends are CR LF, found in the raw text."""
    d = t.documents.filter(F.length("text") >= 70).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("raw"), F.translate(F.substring("text", 40, 30), ".", "．").alias("q"))
    return d.select("doc_id", relocated("raw", "q").alias("at")).filter("at is not null").select("doc_id", "at.*")


@query("d19_mentions", """WITH m AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), 'All rights reserved|MIT License|Apache License, Version 2.0|License|rights|Version 2')) AS pattern FROM documents) SELECT doc_id, pattern, CASE WHEN pattern LIKE '%License%' THEN 'licence' ELSE 'notice' END AS kind, count(*) AS n FROM m GROUP BY 1, 2, 3""")
def _(t):
    names = ["All rights reserved", "MIT License", "Apache License, Version 2.0", "License", "rights", "Version 2"]
    patterns = t.spark.createDataFrame([(n, "licence" if "License" in n else "notice", 0) for n in names], "pattern string, kind string, priority int")
    return mentions.find_mentions(t.documents, patterns, "doc_id", "text").groupBy("doc_id", "pattern", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("s16_html_text")
def _(t):
    d = docs.extract_text(t.pages, "html", "text")
    return d.select("page_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


def _source(t, files_a_batch=1):
    """The events table as a stream, and a new folder in the shared one."""
    from panelforge.sources.store import shared_folder

    events = t.events
    file = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.dir}/events.parquet")
    whole = file.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(file).isDirectory()
    return ingest.stream(t.spark, f"{t.dir}/events.parquet" if whole else t.dir, events.schema, files_a_batch, "*.parquet" if whole else "events.parquet"), shared_folder(t.spark, "stream")


def _streamed(t, build):
    """Run a stream over the events table to its end and read what it wrote."""
    source, path = _source(t)
    out = build(source)
    ingest.run_available(out, f"{path}/checkpoint", f"{path}/out")
    return t.spark.read.schema(out.schema).parquet(f"{path}/out")


def _parts(t, part):
    """Run a stream over the events table to its end, batch by batch, and read the parts."""
    source, path = _source(t)
    ingest.run_parts(source, f"{path}/checkpoint", f"{path}/out", part)
    return t.spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")


def _plain_times(d, *names):
    return d.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})


@query("st1_idempotent_ingest", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def _(t):
    return _streamed(t, lambda s: ingest.once_only(s.unionByName(s), "event_id", "ts", "30 days")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_windowed_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2, 3", "total", 4)
def _(t):
    parts = _parts(t, ingest.window_parts("ts", "1 day", None, ["event_type"], "value"))
    return _plain_times(ingest.merged_windows(parts, ["event_type"]), "window_start", "window_end")


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def _(t):
    return _plain_times(ingest.merged_sessions(_parts(t, ingest.session_parts("ts", "6 hours", ["user_id"])), ["user_id"]), "session_start", "session_end")
