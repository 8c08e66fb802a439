"""Further aggregates, selections and event filters as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.operators import pit, roll, xsec
from panelforge.plans.base import PANEL, RETURNS, panel, query, with_returns
from panelforge.plans.q_panel import WC
from panelforge.plans.q_pit import rank_sql


@query("a3_segment_concentration", """WITH g AS (SELECT l_suppkey, l_partkey, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1, 2), s AS (SELECT *, v / sum(v) OVER (PARTITION BY l_suppkey) AS w FROM g) SELECT l_suppkey, sum(w * w) AS hhi, max(w) AS top FROM s GROUP BY 1""", "hhi top")
def _(t):
    g = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    s = g.withColumn("w", F.col("v") / F.sum("v").over(W.partitionBy("l_suppkey")))
    return s.groupBy("l_suppkey").agg(F.sum(F.col("w") ** 2).alias("hhi"), F.max("w").alias("top"))


@query("a6_block_trades", """WITH g AS (SELECT l_suppkey, l_shipdate, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount, count(*) AS trades, count(DISTINCT l_partkey) AS parties, bool_or(l_discount > 0.09) AS bad FROM lineitem GROUP BY 1, 2)
 SELECT l_suppkey, l_shipdate, volume, amount, trades, parties, amount / volume AS vwap FROM g WHERE NOT bad""", "vwap")
def _(t):
    bad = t.lineitem.filter("l_discount > 0.09").select("l_suppkey", "l_shipdate").distinct()
    g = t.lineitem.join(bad, ["l_suppkey", "l_shipdate"], "left_anti").groupBy("l_suppkey", "l_shipdate")
    g = g.agg(F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("amount"), F.count(F.lit(1)).alias("trades"), F.count_distinct("l_partkey").alias("parties"))
    return g.withColumn("vwap", F.col("amount") / F.col("volume"))


@query("a7_unlock_conflicts", """WITH l AS (SELECT o_custkey AS code, o_orderpriority AS kind, max(o_orderdate) AS ann FROM orders GROUP BY 1, 2), r AS (SELECT o.* FROM orders o JOIN l ON o_custkey = code AND o_orderpriority = kind AND o_orderdate = ann),
 c AS (SELECT o_custkey, o_orderpriority, count(DISTINCT o_orderstatus) AS n, round(sum(o_totalprice), 2) AS v FROM r GROUP BY 1, 2) SELECT o_custkey AS code, count(*) AS kinds, round(sum(v), 2) AS total FROM c WHERE n = 1 GROUP BY 1""")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("code"), F.col("o_orderpriority").alias("kind"), "o_orderdate", "o_orderstatus", "o_totalprice")
    last = o.withColumn("ann", F.max("o_orderdate").over(W.partitionBy("code", "kind"))).filter("o_orderdate = ann")
    c = last.groupBy("code", "kind").agg(F.count_distinct("o_orderstatus").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("v")).filter("n = 1")
    return c.groupBy("code").agg(F.count(F.lit(1)).alias("kinds"), F.round(F.sum("v"), 2).alias("total"))


@query("a8_earliest_unambiguous", """WITH q AS (SELECT o_custkey, date_trunc('quarter', o_orderdate) AS q, min(o_orderdate) AS first FROM orders GROUP BY 1, 2) SELECT q.o_custkey, q.q, max(o_totalprice) AS value FROM q JOIN orders o ON o.o_custkey = q.o_custkey AND o.o_orderdate = q.first GROUP BY 1, 2 HAVING count(DISTINCT o_totalprice) = 1""")
def _(t):
    o = t.orders.select("o_custkey", F.date_trunc("quarter", "o_orderdate").alias("q"), "o_orderdate", "o_totalprice")
    first = o.withColumn("first", F.min("o_orderdate").over(W.partitionBy("o_custkey", "q"))).filter("o_orderdate = first")
    return first.groupBy("o_custkey", "q").agg(F.count_distinct("o_totalprice").alias("n"), F.max("o_totalprice").alias("value")).filter("n = 1").drop("n")


@query("a19_yearly_evidence", f"""WITH {RETURNS}, y AS (SELECT industry, substr(trade_date, 1, 4) AS year, count(*) AS n, sum(return_1) AS s FROM returns WHERE return_1 IS NOT NULL GROUP BY 1, 2)
 SELECT industry, sum(n)::BIGINT AS n, sum(s) / sum(n) AS mean, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0 END) AS positive_years, max(abs(s)) / sum(abs(s)) AS top_year_share FROM y GROUP BY 1""", "mean positive_years top_year_share")
def _(t):
    y = with_returns(t).filter("return_1 is not null").groupBy("industry", F.substring("trade_date", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("return_1").alias("s"))
    return y.groupBy("industry").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), F.avg((F.col("s") > 0).cast("double")).alias("positive_years"), (F.max(F.abs("s")) / F.sum(F.abs("s"))).alias("top_year_share"))


@query("a22_recent_panel", f"WITH {PANEL}, d AS (SELECT *, dense_rank() OVER (PARTITION BY code ORDER BY trade_date DESC) AS r FROM panel) SELECT code, count(*) AS n, avg(close) AS mean FROM d WHERE r <= 12 GROUP BY 1", "mean", 4)
def _(t):
    d = panel(t).withColumn("r", F.dense_rank().over(W.partitionBy("code").orderBy(F.desc("trade_date")))).filter("r <= 12")
    return d.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean"))


@query("a23_factor_summary", """WITH d AS (SELECT unnest(string_split(o_orderpriority || ':1.5:' || CAST(o_custkey AS VARCHAR) || ';' || o_orderstatus || ':0:2', ';')) AS part FROM orders)
 SELECT string_split(part, ':')[1] AS factor, avg(TRY_CAST(string_split(part, ':')[-1] AS DOUBLE)) AS contribution, count(*) AS n FROM d GROUP BY 1""", "contribution")
def _(t):
    text = F.concat("o_orderpriority", F.lit(":1.5:"), F.col("o_custkey").cast("string"), F.lit(";"), "o_orderstatus", F.lit(":0:2"))
    d = t.orders.select(F.explode(F.split(text, ";")).alias("detail")).select(F.split("detail", ":").alias("part"))
    return d.groupBy(F.col("part")[0].alias("factor")).agg(F.avg(F.element_at("part", -1).try_cast("double")).alias("contribution"), F.count(F.lit(1)).alias("n"))


@query("a37_event_normalisation", """WITH e AS (SELECT user_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, event_type, (CASE event_type WHEN 'purchase' THEN 1 WHEN 'refund' THEN -1 ELSE 0 END) * value AS score, event_id FROM events)
 SELECT user_id, day, event_type, score FROM e QUALIFY row_number() OVER (PARTITION BY user_id, day, event_type ORDER BY score DESC, event_id) = 1""", "score")
def _(t):
    direction = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "refund", -1).otherwise(0)
    e = t.events.select("user_id", F.to_date(F.col("ts") + F.expr("interval 8 hours")).alias("day"), "event_type", (direction * F.col("value")).alias("score"), "event_id")
    return e.withColumn("n", F.row_number().over(W.partitionBy("user_id", "day", "event_type").orderBy(F.desc("score"), "event_id"))).filter("n = 1").select("user_id", "day", "event_type", "score")


@query("a38_study_selection", "SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'large' WHEN o_totalprice >= 250000 THEN 'medium' END AS family FROM orders WHERE o_totalprice >= 250000 AND o_orderstatus <> 'P'")
def _(t):
    family = F.when(F.col("o_totalprice") >= 400000, "large").when(F.col("o_totalprice") >= 250000, "medium")
    return t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey", family.alias("family")).filter("family is not null")


@query("k2_broadcast_shift", f"WITH {PANEL}, m AS (SELECT trade_date, round(avg(volume), 6) AS level FROM panel GROUP BY 1) SELECT code, trade_date, close + 0.3 * level AS score FROM panel JOIN m USING (trade_date)", "score", 4)
def _(t):
    p = panel(t)
    m = p.groupBy("trade_date").agg(F.round(F.avg("volume"), 6).alias("level"))
    return p.join(m, "trade_date").select("code", "trade_date", (F.col("close") + 0.3 * F.col("level")).alias("score"))


@query("k13_horizon_blend", """WITH p AS (SELECT o_custkey AS code, o_orderpriority AS horizon, arg_max(o_totalprice, o_orderkey) AS edge FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1, 2)
 SELECT code, sum(edge * CASE horizon WHEN '1-URGENT' THEN 0.5 WHEN '2-HIGH' THEN 0.3 ELSE 0.2 END) AS blended FROM p GROUP BY 1 HAVING count(*) = 3""", "blended", 4)
def _(t):
    p = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")).groupBy(F.col("o_custkey").alias("code"), F.col("o_orderpriority").alias("horizon")).agg(F.max_by("o_totalprice", "o_orderkey").alias("edge"))
    weight = F.when(F.col("horizon") == "1-URGENT", 0.5).when(F.col("horizon") == "2-HIGH", 0.3).otherwise(0.2)
    return p.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("edge") * weight).alias("blended")).filter("n = 3").drop("n")


@query("k15_score_buckets", f"""WITH {RETURNS}, n AS (SELECT *, lead(return_1) OVER ({WC}) AS next FROM returns), r AS (SELECT next, {rank_sql('return_1', 'trade_date')} AS k FROM n) SELECT CAST(least(floor(k * 5), 4) AS INTEGER) AS bucket, count(*) AS n, avg(next) AS mean FROM r WHERE k IS NOT NULL AND next IS NOT NULL GROUP BY 1""", "mean")
def _(t):
    d = with_returns(t).withColumn("next", F.lead("return_1").over(roll.series())).withColumn("k", xsec.pct_rank("return_1", ["trade_date"]))
    return d.filter("k is not null and next is not null").groupBy(xsec.relevance_bins("k", 5).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("next").alias("mean"))


@query("w10_fundamental_stability", """WITH q AS (SELECT o_custkey AS code, strftime(date_trunc('quarter', o_orderdate), '%Y%m%d') AS q, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)
 SELECT code, q, CASE WHEN count(v) OVER w >= 2 THEN -stddev_samp(v) OVER w END AS stability, v / nullif(lag(v, 4) OVER (PARTITION BY code ORDER BY q), 0) - 1 AS growth FROM q WINDOW w AS (PARTITION BY code ORDER BY q ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""", "stability growth", 3)
def _(t):
    q = t.orders.groupBy(F.col("o_custkey").alias("code"), F.date_format(F.date_trunc("quarter", "o_orderdate"), "yyyyMMdd").alias("q")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    w = roll.series("code", "q")
    return q.select("code", "q", (-roll.std("v", 4, 2, w)).alias("stability"), roll.change("v", 4, w).alias("growth"))


@query("w11_macro_release", """WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, count(*)::DOUBLE AS x FROM orders GROUP BY 1) SELECT CAST(last_day(m) + INTERVAL 15 DAY AS DATE) AS available_from, x - lag(x) OVER (ORDER BY m) AS change FROM m""", "change")
def _(t):
    m = t.orders.groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    return m.select(F.date_add(F.last_day("m"), 15).alias("available_from"), (F.col("x") - F.lag("x").over(W.orderBy("m"))).alias("change"))


@query("w16_continuous_prices", f"WITH {PANEL} SELECT code, trade_date, close * 1.25 AS adjusted_close, open * 1.25 AS adjusted_open FROM panel", "adjusted_close adjusted_open")
def _(t):
    p = pit.keep_last(panel(t).withColumn("factor", F.lit(1.25)), ["code", "trade_date"], [F.col("close")])
    return p.filter("factor > 0").select("code", "trade_date", (F.col("close") * F.col("factor")).alias("adjusted_close"), (F.col("open") * F.col("factor")).alias("adjusted_open"))


@query("a21_monthly_review", f"WITH {RETURNS} SELECT account, substr(trade_date, 1, 6) AS month, avg(return_1) AS mean_return, count(DISTINCT code) AS names, max(trade_date) AS last_day FROM returns GROUP BY 1, 2", "mean_return")
def _(t):
    return with_returns(t).groupBy("account", F.substring("trade_date", 1, 6).alias("month")).agg(F.avg("return_1").alias("mean_return"), F.count_distinct("code").alias("names"), F.max("trade_date").alias("last_day"))


@query("k3_sector_sentiment", f"WITH {RETURNS} SELECT code, trade_date, coalesce(CASE industry WHEN 'NATION_1' THEN 0.5 WHEN 'NATION_2' THEN -0.25 END, 0) AS sentiment FROM returns", "sentiment")
def _(t):
    mood = t.spark.createDataFrame([("NATION_1", 0.5), ("NATION_2", -0.25)], "industry string, mood double")
    return with_returns(t).join(mood, "industry", "left").select("code", "trade_date", F.coalesce("mood", F.lit(0.0)).alias("sentiment"))


@query("k7_transparent_score", f"""WITH {RETURNS}, f AS (SELECT code, trade_date, close / lag(close, 20) OVER ({WC}) - 1 AS mom, volume AS vol FROM returns), r AS (SELECT code, trade_date, {rank_sql('mom', 'trade_date')} AS a, {rank_sql('vol', 'trade_date')} AS b FROM f)
 SELECT code, trade_date, (coalesce(a, 0) * 0.7 + coalesce(b, 0) * 0.3) / (CASE WHEN a IS NULL THEN 0 ELSE 0.7 END + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END) AS score FROM r""", "score")
def _(t):
    from panelforge.functions.scalar import weighted_mean_of_available

    d = with_returns(t).withColumn("mom", roll.change("close", 20)).withColumn("a", xsec.pct_rank("mom", ["trade_date"])).withColumn("b", xsec.pct_rank("volume", ["trade_date"]))
    return d.select("code", "trade_date", weighted_mean_of_available([("a", 0.7), ("b", 0.3)]).alias("score"))


@query("d11_event_features", """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) SELECT d.user_id, d.d, ln(1 + count(e.event_id)) AS intensity, count(DISTINCT e.event_type) AS sources, coalesce(sum(power(0.5, date_diff('day', CAST(e.ts AS DATE), d.d) / 3.0)), 0) AS decay
 FROM d LEFT JOIN events e ON e.user_id = d.user_id AND date_diff('day', CAST(e.ts AS DATE), d.d) BETWEEN 0 AND 5 GROUP BY 1, 2""", "intensity decay")
def _(t):
    e = t.events.select(F.col("user_id").alias("u"), F.to_date("ts").alias("ed"), "event_id", "event_type")
    days = t.events.select("user_id", F.to_date("ts").alias("d")).distinct().withColumn("slot", F.floor(F.unix_date("d") / 6))
    e = e.withColumn("eslot", F.explode(F.array(F.floor(F.unix_date("ed") / 6), F.floor(F.unix_date("ed") / 6) + 1)))
    age = F.datediff("d", "ed")
    j = days.join(e, (F.col("user_id") == F.col("u")) & (F.col("slot") == F.col("eslot")) & age.between(0, 5), "left")
    return j.groupBy("user_id", "d").agg(F.log1p(F.count("event_id")).alias("intensity"), F.count_distinct("event_type").alias("sources"), F.coalesce(F.sum(F.pow(F.lit(0.5), age / 3.0)), F.lit(0.0)).alias("decay"))


@query("w12_premium_persistence", f"""WITH {PANEL}, b AS (SELECT trade_date, round(avg(close), 6) AS nav FROM panel GROUP BY 1), p AS (SELECT code, trade_date, close / nav - 1 AS premium FROM panel JOIN b USING (trade_date))
 SELECT code, trade_date, premium, CASE WHEN count(premium) OVER w >= 5 THEN avg(CASE WHEN premium > 0 THEN 1.0 ELSE 0 END) OVER w END AS persistence FROM p WINDOW w AS ({WC} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "premium persistence")
def _(t):
    p = panel(t)
    d = p.join(p.groupBy("trade_date").agg(F.round(F.avg("close"), 6).alias("nav")), "trade_date").withColumn("premium", F.col("close") / F.col("nav") - 1)
    return d.withColumn("up", (F.col("premium") > 0).cast("double")).select("code", "trade_date", "premium", roll.mean("up", 20, 5).alias("persistence"))
