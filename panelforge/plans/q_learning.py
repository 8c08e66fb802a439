"""Preparation, fitting, calibration, selection and drift as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.operators import evaluation as evalu
from panelforge.operators import calibration as calib
from panelforge.operators import learning, performance, ranking, roll
from panelforge.operators import allocation as alloc
from panelforge.operators import increment as incr
from panelforge.operators import portfolio as port
from panelforge.functions.scalar import corr
from panelforge.plans.base import RETURNS, query, with_returns
from panelforge.plans.q_accounts import IC, NAV, PROBS, nav, probs, signal
from panelforge.plans.q_panel import WC, roll_sql
from panelforge.sources.store import held

FEATURES = f"{RETURNS}, lf AS (SELECT code, trade_date, close / nullif(lag(close, 20) OVER ({WC}), 0) - 1 AS momentum, close / nullif(lag(close, 5) OVER ({WC}), 0) - 1 AS short, {roll_sql('stddev_samp', 'return_1', 20)} AS vol, ln(amount) AS size, lead(close, 5) OVER ({WC}) / close - 1 AS y FROM returns)"
NAMES = ["momentum", "short", "vol", "size"]
def train():
    return F.col("trade_date") < "19970101"


def featured(t):
    d = with_returns(t)
    return d.select("code", "trade_date", roll.change("close", 20).alias("momentum"), roll.change("close", 5).alias("short"), roll.std("return_1", 20).alias("vol"), F.log("amount").alias("size"), (F.lead("close", 5).over(roll.series()) / F.col("close") - 1).alias("y"))


M2 = f"""{FEATURES}, mt AS (SELECT *, trade_date < '19970101' AS train FROM lf), """ + ", ".join(f"q_{c} AS (SELECT quantile_cont({c}, 0.01) AS lo, median({c}) AS mid, quantile_cont({c}, 0.99) AS hi FROM mt WHERE train)" for c in NAMES) + ", mc AS (SELECT code, trade_date, y, train, " + ", ".join(f"greatest(least(coalesce({c}, q_{c}.mid), q_{c}.hi), q_{c}.lo) AS {c}" for c in NAMES) + " FROM mt, " + ", ".join(f"q_{c}" for c in NAMES) + "), ms AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NAMES) + " FROM mc WHERE train), mz AS (SELECT code, trade_date, y, train, " + ", ".join(f"CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0 END AS {c}" for c in NAMES) + " FROM mc, ms)"


@query("m2_imputed_features", f"WITH {M2} SELECT code, trade_date, momentum, short, vol, size FROM mz", "momentum short vol size", 4)
def _(t):
    return learning.imputed(featured(t), train(), NAMES).select("code", "trade_date", *NAMES)


@query("m3_ridge_scores")
def _(t):
    d = learning.imputed(featured(t), train(), NAMES)
    return learning.ridge_scores(d, train(), NAMES, "y", 1.0).select("code", "trade_date", "score")


@query("m3_classifier_scores")
def _(t):
    d = learning.imputed(featured(t), train(), NAMES).filter("y is not null").withColumn("up", (F.col("y") > 0).cast("int"))
    return learning.classifier_scores(d, train(), NAMES, "up", trees=5).select("code", "trade_date", "up", "probability")


@query("m4_edge_calibration")
def _(t):
    return learning.edge_calibration(signal(t), "x", "y", "trade_date", 5, 5)


@query("m4_bucket_means", f"WITH {IC.split(', v AS')[0]}, v AS (SELECT *, ntile(5) OVER (PARTITION BY trade_date ORDER BY x, code) AS bucket FROM s WHERE x IS NOT NULL AND y IS NOT NULL), m AS (SELECT bucket, trade_date, avg(y) AS m FROM v GROUP BY 1, 2) SELECT bucket, count(*) AS dates, avg(m) AS mean, stddev_samp(m) / sqrt(greatest(count(*) / 5.0, 1)) AS error FROM m GROUP BY 1", "mean error", 4)
def _(t):
    return learning.edge_calibration(signal(t), "x", "y", "trade_date", 5, 5).select("bucket", "dates", "mean", "error")


@query("m5_half_life", f"WITH {IC}, l AS (SELECT substr(trade_date, 1, 4) AS year, round(ic, 9) AS ic, lag(round(ic, 9)) OVER (PARTITION BY substr(trade_date, 1, 4) ORDER BY trade_date) AS l FROM ic), a AS (SELECT year, corr(ic, l) AS a FROM l GROUP BY 1) SELECT year, a AS autocorr, CASE WHEN a > 0 AND a < 1 THEN greatest(1, least(60, ln(0.5) / ln(a))) WHEN a >= 1 THEN 60 WHEN a <= 0 THEN 1 END AS half_life FROM a", "autocorr half_life", 4)
def _(t):
    ic = evalu.daily_ic(signal(t), ["trade_date"], "x", "y").withColumn("year", F.substring("trade_date", 1, 4)).withColumn("ic", F.round("ic", 9))
    before = F.lag("ic").over(W.partitionBy("year").orderBy("trade_date"))
    a = ic.withColumn("l", before).groupBy("year").agg(corr("ic", "l").alias("autocorr"))
    return a.select("year", "autocorr", evalu.half_life("autocorr").alias("half_life"))


@query("m6_overfitting")
def _(t):
    """Deflated Sharpe ratio of the best account and the probability that choosing it is overfitting, from sums of eight blocks of dates."""
    r = nav(t).withColumn("r", roll.change("v", 1, W.partitionBy("account").orderBy("trade_date"))).filter("r is not null")
    dates = r.select("trade_date").distinct().withColumn("block", F.ntile(8).over(W.orderBy("trade_date")) - 1)
    sums = r.join(F.broadcast(dates), "trade_date").groupBy("account", "block").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") ** 2).alias("q"))  # a row a date
    return t.spark.createDataFrame([evalu.overfitting(sums, "account")], "account string, sharpe double, deflated double, overfitting double")


@query("m7_block_bootstrap")
def _(t):
    ic = evalu.daily_ic(signal(t), ["trade_date"], "x", "y").withColumn("year", F.substring("trade_date", 1, 4))

    def run(pdf):
        values = pdf.sort_values("trade_date")["ic"].to_numpy()
        return pdf.head(1)[["year"]].assign(n=len(values), probability=evalu.stationary_bootstrap(values, 10.0, 200, 11))

    return ic.groupBy("year").applyInPandas(run, "year string, n long, probability double")  # a year is some 250 numbers


@query("m8_confidence", "SELECT o_orderkey, greatest(least(CASE WHEN o_orderkey % 700 < 100 OR o_orderstatus = 'P' THEN least(c, 0.49) ELSE c END, 1), 0) AS confidence FROM (SELECT *, 0.30 * ((o_orderkey % 11) / 10.0) + 0.20 * least(greatest((o_orderkey % 700) / 500.0, 0), 1) + 0.20 * ((o_custkey % 7) / 6.0) + 0.15 * 0.9 + 0.15 * ((o_custkey % 5) / 4.0) AS c FROM orders)", "confidence")
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select("o_orderkey", learning.confidence(k % 11 / 10.0, k % 700, c % 7 / 6.0, F.lit(0.9), c % 5 / 4.0, F.col("o_orderstatus") == "P").alias("confidence"))


@query("m9_drift_windows", """WITH d AS (SELECT o_orderpriority AS scope, CAST(o_orderdate AS DATE) AS d, round(avg(o_totalprice) / 1e6, 9) AS psi FROM orders GROUP BY 1, 2), w AS (SELECT *, avg(psi) OVER a AS m30, count(psi) OVER a AS n30, avg(psi) OVER b AS m90, count(psi) OVER b AS n90 FROM d WINDOW a AS (PARTITION BY scope ORDER BY d RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW), b AS (PARTITION BY scope ORDER BY d RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW))
 SELECT scope, d, m30 AS psi_30d, m90 AS psi_90d, CASE WHEN n30 < 20 THEN 'insufficient_evidence' WHEN round(m30, 9) >= 0.16 THEN 'quarantine' WHEN round(m30, 9) >= 0.15 THEN 'warning' ELSE 'available' END AS state_30d, CASE WHEN n90 < 60 THEN 'insufficient_evidence' WHEN round(m90, 9) >= 0.16 THEN 'quarantine' WHEN round(m90, 9) >= 0.15 THEN 'warning' ELSE 'available' END AS state_90d FROM w""", "psi_30d psi_90d")
def _(t):
    d = t.orders.groupBy(F.col("o_orderpriority").alias("scope"), F.to_date("o_orderdate").alias("d")).agg(F.round(F.avg("o_totalprice") / 1e6, 9).alias("psi"))
    return learning.drift_windows(d, ["scope"], "d", "psi", {30: 20, 90: 60}, 0.15, 0.16).select("scope", "d", "psi_30d", "psi_90d", "state_30d", "state_90d")


@query("m10_admission_gate", "SELECT o_custkey, n, concat_ws('|', CASE WHEN n >= 8 THEN NULL ELSE 'too_few' END, CASE WHEN mean > 150000 THEN NULL ELSE 'low_mean' END, CASE WHEN open_share < 0.6 THEN NULL ELSE 'too_open' END) AS reasons, n >= 8 AND mean > 150000 AND open_share < 0.6 AS admitted FROM (SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 4) AS mean, avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END) AS open_share FROM orders GROUP BY 1)")
def _(t):
    g = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.avg((F.col("o_orderstatus") == "O").cast("double")).alias("open_share"))
    d = learning.gate(g, [("too_few", F.col("n") >= 8), ("low_mean", F.col("mean") > 150000), ("too_open", F.col("open_share") < 0.6)])
    return d.select("o_custkey", "n", F.array_join("reasons", "|").alias("reasons"), "admitted")


@query("k10_selected_features")
def _(t):
    d = featured(t).withColumn("copy", F.col("momentum") * 2)
    return learning.select_features(d, [*NAMES, "copy"], "y", {"momentum": "trend", "copy": "trend", "short": "trend"}, least_ic=0.0, least_stability=0.3, least_t=0.0)


@query("k10_feature_audit", f"""WITH {FEATURES}, l AS (SELECT code, trade_date, y, feature, value FROM lf UNPIVOT INCLUDE NULLS (value FOR feature IN (momentum, short, vol, size))),
 r AS (SELECT *, CASE WHEN value IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date, feature, value IS NULL ORDER BY value) + (count(*) OVER (PARTITION BY trade_date, feature, value) - 1) / 2.0) / count(value) OVER (PARTITION BY trade_date, feature) END AS k, CASE WHEN y IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date, feature, y IS NULL ORDER BY y) + (count(*) OVER (PARTITION BY trade_date, feature, y) - 1) / 2.0) / count(y) OVER (PARTITION BY trade_date, feature) END AS u FROM l),
 c AS (SELECT *, k - avg(k) OVER (PARTITION BY trade_date, feature) AS a, u - avg(u) OVER (PARTITION BY trade_date, feature) AS b FROM r) SELECT feature, avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) AS coverage, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS correlation FROM (SELECT feature, value, a, b FROM c) GROUP BY 1""".replace("sum(a * a) * sum(b * b)", "sum(a * a) * sum(b * b)"), "coverage correlation", 4)
def _(t):
    return learning.feature_audit(featured(t), NAMES, "y").select("feature", "coverage", "correlation")


@query("k11_signed_ic_features")
def _(t):
    return learning.signed_ic_features(featured(t), NAMES, "y", {}, 5, rate=0.9)


@query("a18_backtest_metrics", f"""WITH {NAV}, a AS (SELECT trade_date, round(sum(v), 6) AS p, round(sum(first * bench / bench0), 6) AS q FROM (SELECT *, arg_min(v, trade_date) OVER (PARTITION BY account) AS first, arg_min(bench, trade_date) OVER (PARTITION BY account) AS bench0 FROM nav) GROUP BY 1),
 r AS (SELECT *, p / lag(p) OVER w - 1 AS r, q / lag(q) OVER w - 1 AS b, p / max(p) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM a WINDOW w AS (ORDER BY trade_date))
 SELECT arg_max(p, trade_date) / arg_min(p, trade_date) - 1 AS cum_return, stddev_samp(r) * sqrt(252) AS volatility, min(dd) AS max_drawdown, avg(r - b) / stddev_samp(r - b) * sqrt(252) AS information_ratio FROM r""", "cum_return volatility max_drawdown information_ratio", 4)
def _(t):
    return performance.backtest_metrics(nav(t), "account", "trade_date", "v", "bench").select("cum_return", "volatility", "max_drawdown", "information_ratio")


@query("a20_clustered_probability")
def _(t):
    d = signal(t).filter("y is not null").withColumn("year", F.substring("trade_date", 1, 4))
    p = learning.clustered_probability(d, "year", "y", "all", 500, 3)
    return t.spark.createDataFrame([("all", p)], "family string, probability double")


@query("a28_calibration_slope")
def _(t):
    d = probs(t).withColumn("y", (F.col("label") == "up").cast("int"))
    return t.spark.createDataFrame([(evalu.calibration_slope(d, "up", "y"),)], "slope double")


@query("a29_drift_and_range", """WITH x AS (SELECT l_returnflag AS k, l_shipdate < TIMESTAMP '1997-01-01' AS old, l_quantity AS v FROM lineitem), q AS (SELECT k, quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) AS e, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM x WHERE old GROUP BY 1),
 b AS (SELECT k, old, CAST(v > e[1] AS INTEGER) + CAST(v > e[2] AS INTEGER) + CAST(v > e[3] AS INTEGER) + CAST(v > e[4] AS INTEGER) AS bin, v < lo OR v > hi AS outside FROM x JOIN q USING (k)),
 c AS (SELECT k, bin, greatest(count(*) FILTER (WHERE NOT old) / nullif(sum(count(*) FILTER (WHERE NOT old)) OVER (PARTITION BY k), 0), 1e-6) AS a, greatest(count(*) FILTER (WHERE old) / sum(count(*) FILTER (WHERE old)) OVER (PARTITION BY k), 1e-6) AS e FROM b GROUP BY 1, 2)
 SELECT k, (SELECT avg(CAST(outside AS INTEGER)) FROM b WHERE b.k = c.k AND NOT old) AS ood_ratio, sum((a - e) * ln(a / e)) AS psi FROM c WHERE a IS NOT NULL GROUP BY 1 HAVING (SELECT count(*) FROM b WHERE b.k = c.k AND NOT old) > 0""", "ood_ratio psi")
def _(t):
    x = t.lineitem.select(F.col("l_returnflag").alias("k"), (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")).alias("old"), F.col("l_quantity").alias("v"))
    return evalu.feature_drift(x.filter("not old"), x.filter("old"), ["k"], "v", 5)


@query("p14_correlation_clusters", f"""WITH RECURSIVE {RETURNS}, r AS (SELECT industry, trade_date, round(avg(return_1), 9) AS r FROM returns WHERE return_1 IS NOT NULL GROUP BY 1, 2), p AS (SELECT a.industry AS a, b.industry AS b FROM r a JOIN r b ON a.trade_date = b.trade_date AND a.industry < b.industry GROUP BY 1, 2 HAVING count(*) >= 20 AND corr(a.r, b.r) >= 0.02),
 e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), reach AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y) SELECT x AS industry, min(y) AS cluster FROM reach GROUP BY 1""")
def _(t):
    r = with_returns(t).filter("return_1 is not null").groupBy("industry", "trade_date").agg(F.round(F.avg("return_1"), 9).alias("r"))
    found = port.clusters(port.correlation_pairs(r, "industry", "trade_date", "r", 20), 0.02)
    return t.spark.createDataFrame(sorted(found.items()), "industry string, cluster string")


@query("p6_mean_variance")
def _(t):
    r = with_returns(t).filter("return_1 is not null").groupBy("industry", "account", "trade_date").agg(F.round(F.avg("return_1") / 100, 9).alias("r"))
    return port.mean_variance(r, "account", "industry", "trade_date", "r", risk_aversion=5.0, name_cap=0.4, budget=0.95, most=4)


@query("p7_residual_lots")
def _(t):
    d = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("code")).agg(F.round(F.avg("o_totalprice") / 1e4, 4).alias("price"), F.count(F.lit(1)).alias("n"))
    d = d.withColumn("weight", F.col("n") / F.sum("n").over(W.partitionBy("o_custkey")) * 0.95)
    return port.residual_lots(d.withColumn("nav", F.lit(200_000.0)), "o_custkey", 100, 0.45).select("o_custkey", "code", "shares")


@query("p11_live_orders")
def _(t):
    from panelforge.plans.q_strategy import scored_by_date

    d = scored_by_date(t).withColumn("p", F.row_number().over(W.partitionBy("trade_date").orderBy(F.desc("score"), "code")))
    dates = d.select("trade_date").distinct().withColumn("next", F.lead("trade_date").over(W.orderBy("trade_date")))
    prices = with_returns(t).select("trade_date", "code", F.round("close", 2).alias("price"))
    held = d.filter("p <= 6").join(dates, "trade_date").filter("next is not null").select(F.col("next").alias("trade_date"), "code", (F.col("p") * 1000).alias("shares"), (F.col("p") * 900).alias("sellable"))
    book = d.select("trade_date", "code", F.when(F.col("p") <= 8, 0.11).alias("weight")).join(prices, ["trade_date", "code"]).join(held, ["trade_date", "code"], "left")
    out = port.target_orders(book.filter("weight is not null or shares is not null").withColumn("cash", F.lit(500_000.0)), ["trade_date"], 100, 0.0003, 5.0, 0.001)
    return out.select("trade_date", "code", "side", "shares", "value", "cash_after")


EVENTS = f"{FEATURES}, ev AS (SELECT code, trade_date, momentum, vol, y, CASE WHEN abs(short) > 1 THEN sign(short) ELSE 0 END AS ev_jump, CASE WHEN size > 12 THEN 1.0 ELSE 0 END AS ev_burst, CASE WHEN momentum IS NULL THEN 0 ELSE 1 END AS covered FROM lf)"


def with_events(t):
    """Base features, two event-like ones that are 0 on most days, and where history covers them."""
    jump = F.when(F.abs("short") > 1, F.signum("short")).otherwise(0.0)
    return featured(t).select("code", "trade_date", "momentum", "vol", "y", jump.alias("ev_jump"), F.when(F.col("size") > 12, 1.0).otherwise(0.0).alias("ev_burst"), F.when(F.col("momentum").isNull(), 0).otherwise(1).alias("covered"))


@query("m13_event_support", f"""WITH {EVENTS}, a AS (SELECT trade_date, covered > 0 AS c, covered > 0 AND (abs(ev_jump) > 1e-12 OR abs(ev_burst) > 1e-12) AS a FROM ev),
 g AS (SELECT count(*) AS rows, count(DISTINCT trade_date) AS dates, count(*) FILTER (WHERE c) AS covered_rows, count(*) FILTER (WHERE a) AS active_rows, count(DISTINCT trade_date) FILTER (WHERE a) AS active_dates FROM a)
 SELECT *, covered_rows / rows AS covered_ratio, active_rows / rows AS active_ratio, CASE WHEN active_dates >= 20 AND active_rows >= 100 THEN 'supported' ELSE 'insufficient_support' END AS status FROM g""", "covered_ratio active_ratio")
def _(t):
    return incr.support(with_events(t), ["ev_jump", "ev_burst"], coverage="covered")


@query("m13_paired_bootstrap", f"""WITH {EVENTS}, m AS (SELECT substr(trade_date, 1, 6) AS month, round(avg(vol), 9) AS a, round(avg(momentum), 9) AS b FROM ev GROUP BY 1), d AS (SELECT month, b - a AS d FROM m WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT count(*) AS n, least(5, count(*)) AS size, avg(d) AS mean_delta FROM d),
 b AS (SELECT row_number() OVER (ORDER BY month) - 1 AS start, sum(d) OVER (ORDER BY month ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM d),
 x AS (SELECT sample, CAST('0x' || substr(md5('7:' || sample || ':' || draw), 1, 8) AS BIGINT) % (n - size + 1) AS start, size, ceil(n / size) AS k FROM n, (SELECT unnest(range(400)) AS sample) AS a, (SELECT unnest(range(200)) AS draw) AS c WHERE draw < ceil(n / size)),
 y AS (SELECT sample, sum(s) / (any_value(size) * any_value(k)) AS m FROM x JOIN b USING (start) GROUP BY 1)
 SELECT (SELECT n FROM n) AS periods, (SELECT mean_delta FROM n) AS mean_delta, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, avg(CAST(m > 0 AS INTEGER)) AS positive FROM y""", "mean_delta low high positive")
def _(t):
    m = with_events(t).groupBy(F.substring("trade_date", 1, 6).alias("month")).agg(F.round(F.avg("vol"), 9).alias("a"), F.round(F.avg("momentum"), 9).alias("b"))
    return incr.paired_bootstrap(m, "month", "a", "b", 400, 5, 7)


@query("m13_increment")
def _(t):
    d = with_events(t).withColumn("label_end", F.lead("trade_date", 5).over(roll.series())).filter("y is not null")
    d = d.withColumns({c: F.coalesce(F.greatest(F.least(c, F.lit(2.0)), F.lit(-2.0)), F.lit(0.0)) for c in ("momentum", "vol")})
    return incr.increment(d, ["momentum", "vol"], ["ev_jump", "ev_burst"], "y", "label_end", 5, coverage="covered", samples=500)


def industry_returns(t):
    r = with_returns(t).filter("return_1 is not null")
    return r.groupBy("industry", "account", F.substring("trade_date", 1, 6).alias("month")).agg(F.round(F.avg(F.least("return_1", F.lit(3.0))) / 100, 9).alias("r"))


MONTHLY = f"{RETURNS}, r AS (SELECT industry, account, substr(trade_date, 1, 6) AS month, round(avg(least(return_1, 3.0)) / 100, 9) AS r FROM returns WHERE return_1 IS NOT NULL GROUP BY 1, 2, 3)"


@query("p5_shrunk_covariance", f"""WITH {MONTHLY}, p AS (SELECT account, count(DISTINCT industry) AS p FROM r GROUP BY 1), w AS (SELECT r.account, r.month FROM r JOIN p USING (account) GROUP BY 1, 2 HAVING count(*) = any_value(p.p)), q AS (SELECT r.* FROM r JOIN w USING (account, month)),
 c AS (SELECT q.account, q.month, q.industry, q.r - avg(q.r) OVER (PARTITION BY q.account, q.industry) AS x FROM q), s AS (SELECT a.account, a.industry AS a, b.industry AS b, count(*) AS n, sum(a.x * b.x) / count(*) AS s FROM c a JOIN c b ON a.account = b.account AND a.month = b.month AND a.industry <= b.industry GROUP BY 1, 2, 3),
 f AS (SELECT account, sum(q * q) AS q4 FROM (SELECT account, month, sum(x * x) AS q FROM c GROUP BY 1, 2) AS z GROUP BY 1), t AS (SELECT account, max(n) AS n, sum(s) FILTER (WHERE a = b) AS tr, sum(CASE WHEN a = b THEN 1 ELSE 2 END * s * s) AS s2 FROM s GROUP BY 1),
 k AS (SELECT t.account, tr / p AS mu, greatest(0, least(1, (q4 / n - s2) / n / (s2 - tr * tr / p))) AS k FROM t JOIN p USING (account) JOIN f USING (account))
 SELECT s.account, s.a, s.b, 1e6 * (s.s * (1 - k) + CASE WHEN s.a = s.b THEN k * mu ELSE 0 END) AS cov, k AS shrinkage FROM s JOIN k USING (account)""", "cov shrinkage", 5)
def _(t):
    return alloc.shrunk(industry_returns(t), "account", "industry", "month", "r").select("account", "a", "b", (F.col("cov") * 1e6).alias("cov"), "shrinkage")


@query("p14_blocked_correlations", f"""WITH {MONTHLY} SELECT a.account, a.industry AS a, b.industry AS b, count(*) AS n, corr(a.r, b.r) AS corr FROM r a JOIN r b ON a.account = b.account AND a.month = b.month AND a.industry < b.industry GROUP BY 1, 2, 3 HAVING count(*) >= 6""", "corr", 4)
def _(t):
    d = alloc.covariances(alloc.pair_sums(industry_returns(t), "account", "industry", "month", "r"), 6)
    return d.filter("a < b").select("account", "a", "b", "n", "corr")


def book(t):
    """Candidates of an account: last month's return as alpha, what the first industry of the alphabet holds, equal benchmark."""
    w = W.partitionBy("account")
    last = industry_returns(t).groupBy("account", "industry").agg(F.avg("r").alias("alpha"), F.stddev_samp("r").alias("volatility"))
    first = F.col("industry") == F.min("industry").over(w)
    return last.select("account", "industry", F.round("alpha", 9).alias("alpha"), F.round("volatility", 9).alias("volatility"), F.when(first, 0.3).otherwise(0.0).alias("current"), (1 / F.count(F.lit(1)).over(w)).alias("benchmark"), F.lit(10.0).alias("cost_bps"), F.substring("industry", 1, 1).alias("letter"))


@query("p5_covariance_weights")
def _(t):
    cov = alloc.shrunk(industry_returns(t), "account", "industry", "month", "r")
    return alloc.covariance_weights(book(t), cov, "account", "industry", cap=0.35, budget=0.95, group="letter", group_cap=0.5, turnover_penalty=0.2, band=0.01)


@query("p6_constrained_weights")
def _(t):
    cov = alloc.shrunk(industry_returns(t), "account", "industry", "month", "r")
    limits = alloc.Limits(positions=3, name=0.4, gross=0.95, turnover=0.6, tracking_error=0.02, groups={"letter": 0.6})
    out = alloc.constrained_weights(book(t), cov, "account", "industry", limits, risk_aversion=5.0, active_risk_aversion=1.0)
    return out.select("account", "industry", "weight", "cash", "turnover", "volatility", "tracking_error", F.concat_ws(",", "binding").alias("binding"), "fallback")


def relevant(t):
    """Month-end rows with features and a relevance from 0 to 3 by quarter of the following return; later years are held out."""
    d = featured(t).filter("y is not null")
    place = F.ntile(4).over(W.partitionBy("month").orderBy("y", "code", "trade_date"))
    return d.withColumn("month", F.substring("trade_date", 1, 6)).withColumn("relevance", place - 1)


@query("m3_ranking")
def _(t):
    d = held(relevant(t), "ranking")
    fitted = ranking.fit_ranker(d, train(), NAMES, "relevance", date="month", trees=4, depth=2, count=16)
    return ranking.ndcg(ranking.ranked_scores(d, fitted).withColumn("id", F.concat("code", "trade_date")), "score", "relevance", "month", "id")


@query("m4_isotonic", """WITH g AS (SELECT l_quantity AS x, count(*) AS w, sum(CAST(l_discount * 100 AS DECIMAL(18, 4))) AS t FROM lineitem GROUP BY 1), c AS (SELECT x, w, sum(w) OVER (ORDER BY x) AS w1, sum(t) OVER (ORDER BY x) AS t1, coalesce(sum(w) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0, coalesce(sum(t) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t0 FROM g),
 m AS (SELECT a.x AS j, b.x AS k, (b.t1 - a.t0)::DOUBLE / (b.w1 - a.w0)::DOUBLE AS mean FROM c a JOIN c b ON a.x <= b.x), n AS (SELECT c.x, m.j, min(m.mean) AS low FROM c JOIN m ON m.j <= c.x AND m.k >= c.x GROUP BY 1, 2), f AS (SELECT x, round(max(low), 9) AS fitted FROM n GROUP BY 1)
 SELECT min(x) AS low, max(x) AS high, sum(w)::DOUBLE AS weight, fitted FROM f JOIN g USING (x) GROUP BY fitted""", "fitted")
def _(t):
    return calib.isotonic(t.lineitem.withColumn("v", F.round(F.col("l_discount") * 100, 2)), "l_quantity", "v")


@query("m4_temperature")
def _(t):
    """Temperature of three classes of orders, from logits of the price that are too sure of a class the customer shifts."""
    price = F.col("o_totalprice") / 1e4
    shifted = price + (F.col("o_custkey") % 7 - 3) * 2
    y = F.when(shifted > 25, 0).when(shifted < 10, 1).otherwise(2)
    d = t.orders.select(F.col("o_orderpriority").alias("k"), (price - 25).alias("up"), (10 - price).alias("down"), F.lit(0.0).alias("flat"), y.alias("y"))
    value = calib.temperature(d, ["up", "down", "flat"], "y")
    z = calib.softmax([F.col(c) / value for c in ("up", "down", "flat")])
    return d.select("k", F.lit(value).alias("temperature"), (-F.log(F.get(F.array(*z), F.col("y")))).alias("loss")).groupBy("k", "temperature").agg(F.avg("loss").alias("loss"))


__all__ = ["PROBS"]
