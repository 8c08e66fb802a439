"""Scans, filters and point-in-time joins as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.scalar import code_key, date_key, first_reason, safe_ratio, to_number
from panelforge.operators import pit, xsec
from panelforge.plans.base import MEMBERS, PANEL, UNIVERSE, members, panel, query, universe
from panelforge.sources import store


@query("s4_projection_predicate", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_returnflag = 'R'")
def _(t):
    return store.subset(t.spark, f"{t.dir}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_extendedprice"], "l_shipdate >= timestamp'1997-01-01' and l_returnflag = 'R'")


@query("s5_date_bounds", "SELECT min(l_shipdate) AS first, max(l_shipdate) AS last, count(*) AS rows FROM lineitem")
def _(t):
    return store.bounds(t.lineitem, "l_shipdate")


@query("s8_latest_common_date", "SELECT max(d) AS latest FROM (SELECT strftime(o_orderdate, '%Y%m%d') AS d FROM orders INTERSECT SELECT strftime(l_shipdate, '%Y%m%d') FROM lineitem) WHERE d <= '19970630'")
def _(t):
    return store.latest_common(t.orders.select(F.date_format("o_orderdate", "yyyyMMdd").alias("d")), t.lineitem.select(F.date_format("l_shipdate", "yyyyMMdd").alias("d")), "d", "19970630")


@query("s9_retained_dates", """WITH d AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS d FROM orders), r AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS n FROM d),
 m AS (SELECT max(d) AS d, row_number() OVER (ORDER BY substr(d, 1, 6) DESC) AS k FROM d GROUP BY substr(d, 1, 6)) SELECT d FROM r WHERE n <= 10 OR d IN (SELECT d FROM m WHERE k <= 12) OR d = '19950105'""")
def _(t):
    return store.retained(t.orders.select(F.date_format("o_orderdate", "yyyyMMdd").alias("d")), "d", 10, 12, ["19950105"])


@query("s11_upsert", """SELECT o_custkey, d, o_totalprice, src FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, d ORDER BY src DESC, o_orderkey DESC) AS n FROM
 (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y%m') AS d, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS src FROM orders)) WHERE n = 1""")
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyyMM").alias("d"), "o_totalprice", F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("src"))
    return store.upsert(o.filter("src = 0"), o.filter("src = 1"), ["o_custkey", "d"], "o_orderkey").select("o_custkey", "d", "o_totalprice", "src")


@query("s12_source_fan_in", """SELECT name, nation, balance, 'customer' AS source, '20240101' AS observed_at FROM (SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer)
 UNION ALL SELECT s_name, s_nationkey, s_acctbal, 'supplier', '20240101' FROM supplier""")
def _(t):
    frames, _health = store.fan_in({"customer": t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")), "supplier": t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))}, "20240101")
    return frames


@query("f1_date_and_code_keys", "SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code, strftime(o_orderdate, '%Y%m%d') AS trade_date FROM orders")
def _(t):
    return t.orders.select("o_orderkey", code_key(F.concat(F.col("o_custkey").cast("string"), F.lit(".sz"))).alias("code"), date_key(F.col("o_orderdate").cast("date")).alias("trade_date"))


@query("f2_observable_snapshot", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '1996-06-30'")
def _(t):
    o = t.orders.withColumn("ann_date", F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyyMMdd")))
    return pit.observable(o, "19960630").select("o_orderkey", "o_totalprice")


@query("f3_hard_filters", "SELECT p_partkey FROM part WHERE (CASE WHEN p_size > 5 THEN p_size END IS NULL OR p_size > 10) AND p_retailprice >= 950 AND p_brand IS NOT NULL")
def _(t):
    size = F.when(F.col("p_size") > 5, F.col("p_size"))
    return t.part.filter((size.isNull() | (size > 10)) & (F.col("p_retailprice") >= 950) & F.col("p_brand").isNotNull()).select("p_partkey")


@query("f4_relaxed_fallback", """WITH h AS (SELECT p_brand, count(*) FILTER (WHERE p_size > 48 AND p_retailprice > 1500) AS hard FROM part GROUP BY p_brand)
 SELECT p_partkey, p_brand, CASE WHEN hard = 0 THEN 'relaxed' ELSE 'hard' END AS rule FROM part JOIN h USING (p_brand) WHERE CASE WHEN hard = 0 THEN p_size > 40 ELSE p_size > 48 AND p_retailprice > 1500 END""")
def _(t):
    hard = (F.col("p_size") > 48) & (F.col("p_retailprice") > 1500)
    n = F.sum(hard.cast("int")).over(W.partitionBy("p_brand"))
    d = t.part.withColumn("n", n).withColumn("rule", F.when(F.col("n") == 0, "relaxed").otherwise("hard"))
    return d.filter(F.when(F.col("n") == 0, F.col("p_size") > 40).otherwise(hard)).select("p_partkey", "p_brand", "rule")


RANK = "(rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by})"


def rank_sql(x: str, by: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {RANK.format(x=x, by=by)} END"


@query("f5_preselect", f"""SELECT p_type, p_partkey, score FROM (SELECT p_type, p_partkey, score, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_partkey) AS n FROM
 (SELECT p_type, p_partkey, round(0.35 * (1 - {rank_sql('p_size', 'p_type')}) + 0.65 * {rank_sql('p_retailprice', 'p_type')}, 9) AS score FROM part)) WHERE n <= 5""", "score")
def _(t):
    score = F.round(0.35 * (1 - xsec.pct_rank("p_size", ["p_type"])) + 0.65 * xsec.pct_rank("p_retailprice", ["p_type"]), 9)
    d = t.part.select("p_type", "p_partkey", score.alias("score"))
    return d.withColumn("n", F.row_number().over(W.partitionBy("p_type").orderBy(F.desc("score"), "p_partkey"))).filter("n <= 5").drop("n")


@query("f6_rejection_reasons", """SELECT coalesce(CASE WHEN p_size < 5 THEN 'small' WHEN p_retailprice < 950 THEN 'cheap' WHEN p_brand = 'Brand#11' THEN 'brand' END, 'accepted') AS reason, count(*) AS n FROM part GROUP BY 1""")
def _(t):
    reason = first_reason([(F.col("p_size") < 5, "small"), (F.col("p_retailprice") < 950, "cheap"), (F.col("p_brand") == "Brand#11", "brand")])
    return t.part.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("f7_selection_funnel", """SELECT p_type, count(*) AS universe, count(*) FILTER (WHERE p_size >= 5) AS sized, count(*) FILTER (WHERE p_size >= 5 AND p_retailprice >= 950) AS priced,
 count(*) FILTER (WHERE p_size >= 5 AND p_retailprice >= 950 AND p_brand <> 'Brand#11') AS ready FROM part GROUP BY p_type""")
def _(t):
    a, b, c = F.col("p_size") >= 5, F.col("p_retailprice") >= 950, F.col("p_brand") != "Brand#11"
    n = lambda x: F.sum(F.coalesce(x.cast("int"), F.lit(0))).cast("long")
    return t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("universe"), n(a).alias("sized"), n(a & b).alias("priced"), n(a & b & c).alias("ready"))


@query("f8_f9_coerced_ratio", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value / nullif(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS ratio FROM events""", "k ratio")
def _(t):
    k = to_number(F.get_json_object("props", "$.k"))
    return t.events.select("event_id", k.alias("k"), safe_ratio("value", k).alias("ratio"))


@query("f10_trading_flags", """SELECT l_suppkey, strftime(l_shipdate, '%Y%m%d') AS d, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, array_to_string(list_sort(list_distinct(list(l_linestatus || l_returnflag))), '|') AS kinds,
 CASE WHEN count(*) FILTER (WHERE l_returnflag <> 'R') = 0 THEN 'suspended' WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'partial' ELSE 'tradable' END AS status FROM lineitem GROUP BY 1, 2""")
def _(t):
    r = (F.col("l_returnflag") == "R").cast("int")
    g = t.lineitem.groupBy("l_suppkey", F.date_format("l_shipdate", "yyyyMMdd").alias("d")).agg(F.sum(r).cast("long").alias("returned"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(F.concat("l_linestatus", "l_returnflag"))), "|").alias("kinds"))
    return g.select("l_suppkey", "d", "returned", "kinds", F.when(F.col("n") == F.col("returned"), "suspended").when(F.col("returned") > 0, "partial").otherwise("tradable").alias("status"))


@query("f11_f13_data_audit", """SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeats, count(*) FILTER (WHERE l_quantity <= 0 OR l_extendedprice <= 0) AS bad,
 count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1992-01-01') AS early, count(*) - count(l_discount) AS missing FROM lineitem""")
def _(t):
    n = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0))).cast("long")
    rows = F.count(F.lit(1))
    return t.lineitem.agg(rows.alias("n"), F.count_distinct("l_orderkey").alias("orders"), (rows - F.count_distinct("l_orderkey", "l_linenumber")).alias("repeats"), n((F.col("l_quantity") <= 0) | (F.col("l_extendedprice") <= 0)).alias("bad"), n(F.col("l_shipdate") < F.lit("1992-01-01").cast("timestamp")).alias("early"), (rows - F.count("l_discount")).alias("missing"))


@query("f12_model_candidates", """SELECT c_custkey, c_nationkey, score FROM (SELECT c_custkey, c_nationkey, o_orderkey, o_totalprice / 1000 / greatest(0.005, least(0.5, abs(c_acctbal) / 20000)) AS score,
 row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice / 1000 / greatest(0.005, least(0.5, abs(c_acctbal) / 20000)) DESC, o_orderkey) AS n
 FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 AND c_acctbal > 0) WHERE n = 1""", "score")
def _(t):
    d = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).filter("o_totalprice > 100000 and c_acctbal > 0")
    d = d.withColumn("score", F.col("o_totalprice") / 1000 / F.greatest(F.lit(0.005), F.least(F.lit(0.5), F.abs("c_acctbal") / 20000)))
    return d.withColumn("n", F.row_number().over(W.partitionBy("c_custkey").orderBy(F.desc("score"), "o_orderkey"))).filter("n = 1").select("c_custkey", "c_nationkey", "score")


@query("j1_validated_join", f"WITH {PANEL}, {MEMBERS} SELECT code, trade_date, close, industry FROM panel JOIN members USING (code)", "close")
def _(t):
    return panel(t).join(pit.assert_unique(members(t), ["code"]), "code").select("code", "trade_date", "close", "industry")


@query("j2_exact_date_join", f"""WITH {PANEL}, b AS (SELECT o_custkey, strftime(o_orderdate, '%Y%m%d') AS trade_date, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1, 2)
 SELECT code, panel.trade_date, close, price FROM panel LEFT JOIN b ON CAST(code AS BIGINT) = o_custkey AND panel.trade_date = b.trade_date""", "close")
def _(t):
    b = t.orders.select(code_key(F.col("o_custkey")).alias("code"), F.date_format("o_orderdate", "yyyyMMdd").alias("trade_date"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return pit.exact_date_join(panel(t), b, ["code", "trade_date"], [F.col("o_orderkey")]).select("code", "trade_date", "close", "price")


FUND = """fund AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, o_orderdate AS ann, o_orderkey AS k, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price, o_orderpriority AS prio FROM orders JOIN customer ON o_custkey = c_custkey)"""
SHIP = "ship AS (SELECT DISTINCT s_nationkey AS nation, l_shipdate AS d FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def fund(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.col("o_orderdate").alias("ann"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"), F.col("o_orderpriority").alias("prio"))


def ship(t):
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("nation"), F.col("l_shipdate").alias("d")).distinct()


LAST_FUND = "last_fund AS (SELECT nation, ann, arg_max({'price': price, 'prio': prio}, k) AS r FROM fund GROUP BY 1, 2)"


@query("j3_asof_backward", f"WITH {FUND}, {SHIP}, {LAST_FUND} SELECT ship.nation, d, f.ann AS asof, f.r.price AS price, f.r.prio AS prio FROM ship ASOF LEFT JOIN last_fund f ON ship.nation = f.nation AND ship.d >= f.ann")
def _(t):
    return pit.asof_join(ship(t), fund(t), ["nation"], "d", "ann", ["price", "prio"], [F.col("k")])


@query("j4_asof_composite_key", """WITH f AS (SELECT c_nationkey AS nation, o_orderpriority AS prio, o_orderdate AS ann, arg_max(o_totalprice, o_orderkey) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
 s AS (SELECT DISTINCT s_nationkey AS nation, CASE l_linestatus WHEN 'O' THEN '1-URGENT' ELSE '5-LOW' END AS prio, l_shipdate AS d FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
 SELECT s.nation, s.prio, d, f.ann AS asof, f.price FROM s ASOF LEFT JOIN f ON s.nation = f.nation AND s.prio = f.prio AND s.d >= f.ann""")
def _(t):
    s = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("nation"), F.when(F.col("l_linestatus") == "O", "1-URGENT").otherwise("5-LOW").alias("prio"), F.col("l_shipdate").alias("d")).distinct()
    return pit.asof_join(s, fund(t).drop("price").join(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")), "k"), ["nation", "prio"], "d", "ann", ["price"], [F.col("k")])


@query("j5_asof_series", """WITH s AS (SELECT date_trunc('month', o_orderdate) AS m, avg(o_totalprice) AS level FROM orders GROUP BY 1), d AS (SELECT DISTINCT l_shipdate AS d FROM lineitem)
 SELECT d, s.m AS asof, level FROM d ASOF LEFT JOIN s ON d.d >= s.m""", "level", 4)
def _(t):
    s = t.orders.groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("level"))
    return pit.asof_join(t.lineitem.select(F.col("l_shipdate").alias("d")).distinct(), s, [], "d", "m", ["level"])


@query("j6_membership_asof", f"""WITH {FUND}, {SHIP}, m AS (SELECT nation, ann, max(prio) AS prio, ann + INTERVAL 3 DAY AS until FROM fund GROUP BY 1, 2)
 SELECT ship.nation, d, CASE WHEN d < until THEN prio END AS prio FROM ship ASOF LEFT JOIN m ON ship.nation = m.nation AND ship.d >= m.ann""")
def _(t):
    m = fund(t).withColumn("until", F.col("ann") + F.expr("interval 3 days")).select("nation", "ann", "until", "prio")
    return pit.membership_asof(ship(t), m, ["nation"], "d", "ann", "until", "prio")


@query("j7_asof_staleness", f"""WITH {FUND}, {SHIP}, {LAST_FUND} SELECT ship.nation, d, CASE WHEN date_diff('day', f.ann, d) <= 1 THEN f.ann END AS asof, CASE WHEN date_diff('day', f.ann, d) <= 1 THEN f.r.prio END AS prio
 FROM ship ASOF LEFT JOIN last_fund f ON ship.nation = f.nation AND ship.d >= f.ann""")
def _(t):
    return pit.asof_join(ship(t), fund(t), ["nation"], "d", "ann", ["prio"], [F.col("k")], max_age_days=1)


@query("j8_asof_lag", f"""WITH {FUND}, {SHIP}, l AS (SELECT nation, ann, ann + INTERVAL 5 DAY AS seen, arg_max(prio, k) AS prio FROM fund GROUP BY 1, 2)
 SELECT ship.nation, d, l.ann AS asof, l.prio FROM ship ASOF LEFT JOIN l ON ship.nation = l.nation AND ship.d >= l.seen""")
def _(t):
    return pit.asof_join(ship(t).withColumn("d", F.col("d").cast("date")), fund(t).withColumn("ann", F.col("ann").cast("date")), ["nation"], "d", "ann", ["prio"], [F.col("k")], lag_days=5).withColumn("d", F.col("d").cast("timestamp_ntz")).withColumn("asof", F.col("asof").cast("timestamp_ntz"))


@query("j9_snapshot_membership", f"""WITH {PANEL}, snap AS (SELECT DISTINCT date_trunc('quarter', o_orderdate) AS q FROM orders), mem AS (SELECT date_trunc('quarter', o_orderdate) AS q, o_custkey AS member, min(o_orderpriority) AS account FROM orders GROUP BY 1, 2),
 months AS (SELECT substr(trade_date, 1, 6) AS m, min(strptime(trade_date, '%Y%m%d')) AS first FROM panel GROUP BY 1), pick AS (SELECT m, max(q) AS q FROM months JOIN snap ON q <= first GROUP BY 1)
 SELECT code, trade_date, account FROM panel JOIN pick ON substr(trade_date, 1, 6) = m JOIN mem ON mem.q = pick.q AND member = CAST(code AS BIGINT)""")
def _(t):
    o = t.orders.withColumn("q", F.date_trunc("quarter", "o_orderdate"))
    mem = o.groupBy("q", code_key(F.col("o_custkey")).alias("code")).agg(F.min("o_orderpriority").alias("account"))
    p = panel(t).withColumn("m", F.substring("trade_date", 1, 6))
    months = p.groupBy("m").agg(F.to_timestamp(F.min("trade_date"), "yyyyMMdd").alias("first"))
    pick = pit.asof_join(months, o.select("q").distinct(), [], "first", "q", []).select("m", F.col("asof").alias("q"))
    return p.join(F.broadcast(pick), "m").join(mem, ["q", "code"]).select("code", "trade_date", "account")


@query("j10_interval_join", """SELECT count(*) AS pairs, o_orderpriority FROM orders JOIN (SELECT l_orderkey, l_shipdate, l_quantity FROM lineitem) l ON o_orderkey = l_orderkey AND o_orderdate <= l_shipdate AND l_shipdate < o_orderdate + INTERVAL 60 DAY GROUP BY 2""")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderpriority", F.col("o_orderdate").alias("since"), (F.col("o_orderdate") + F.expr("interval 60 days")).alias("until"))
    j = pit.interval_join(t.lineitem.select(F.col("l_orderkey").alias("k"), "l_shipdate"), o, ["k"], "l_shipdate", "since", "until")
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("pairs"))


@query("j11_name_validity", """SELECT l_orderkey, max(l_linestatus || l_returnflag) AS name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderdate <= l_shipdate AND l_shipdate <= o_orderdate + INTERVAL 90 DAY GROUP BY 1""")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).filter("o_orderdate <= l_shipdate and l_shipdate <= o_orderdate + interval 90 days")
    return j.groupBy("l_orderkey").agg(F.max(F.concat("l_linestatus", "l_returnflag")).alias("name"), F.count(F.lit(1)).alias("n"))


@query("j12_next_session_entry", f"""WITH {PANEL}, s AS MATERIALIZED (SELECT code, trade_date, open, close, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS session FROM panel),
 e AS MATERIALIZED (SELECT DISTINCT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code, strftime(o_orderdate, '%Y%m%d') AS event_date FROM orders),
 u AS (SELECT code, event_date AS d, 1 AS is_event, CAST(NULL AS BIGINT) AS session FROM e UNION ALL SELECT code, trade_date, 0, session FROM s),
 v AS (SELECT code, d AS event_date, is_event, min(session) OVER (PARTITION BY code ORDER BY d DESC, is_event DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS session FROM u),
 n AS MATERIALIZED (SELECT v.code, v.event_date, v.session, s.trade_date AS entry_date, s.open FROM v JOIN s ON v.code = s.code AND v.session = s.session WHERE is_event = 1),
 h AS (SELECT code, event_date, entry_date, open, 1 AS horizon, session AS exit FROM n UNION ALL SELECT code, event_date, entry_date, open, 5, session + 4 FROM n)
 SELECT h.code, event_date, entry_date, horizon, x.trade_date AS exit_date, x.close / h.open - 1 AS ret FROM h LEFT JOIN s x ON x.code = h.code AND x.session = h.exit""", "ret")
def _(t):
    e = t.orders.select(code_key(F.col("o_custkey")).alias("code"), F.date_format("o_orderdate", "yyyyMMdd").alias("event_date")).distinct()
    return pit.next_session_entry(e, panel(t), "code", "event_date", "trade_date", [1, 5]).select("code", "event_date", "entry_date", "horizon", "exit_date", "ret")


@query("j14_source_comparison", """WITH a AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
 SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'primary_only' WHEN a.k IS NULL THEN 'secondary_only' WHEN abs(a.v - b.v) > 1 THEN 'mismatch' ELSE 'matched' END AS status,
 CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND abs(a.v - b.v) > 1 THEN 'v' ELSE '' END AS fields FROM a FULL JOIN b ON a.k = b.k""")
def _(t):
    a, b = (t.orders.filter(c).groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("v")) for c in ("o_orderstatus = 'F'", "o_orderstatus <> 'P'"))
    return pit.outer_compare(a, b, ["k"], {"v": 1.0})


@query("j15_complete_cohort", "SELECT count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3)")
def _(t):
    return pit.complete_cohort(t.lineitem, ["l_orderkey"], "l_returnflag", 3).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("j16_exists_not_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')")
def _(t):
    f, u = t.orders.filter("o_orderstatus = 'F'"), t.orders.filter("o_orderpriority = '1-URGENT'")
    key = F.col("c_custkey") == F.col("o_custkey")
    return t.customer.join(f, key, "left_semi").join(u, key, "left_anti").select("c_custkey")


@query("j17_not_exists_or", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE (l_partkey = p_partkey AND l_returnflag = 'R') OR (l_suppkey = p_partkey AND l_linestatus = 'F'))")
def _(t):
    r, f = t.lineitem.filter("l_returnflag = 'R'"), t.lineitem.filter("l_linestatus = 'F'")
    return t.part.join(r, F.col("p_partkey") == F.col("l_partkey"), "left_anti").join(f, F.col("p_partkey") == F.col("l_suppkey"), "left_anti").select("p_partkey")


@query("j18_benchmark_lookup", f"WITH {PANEL}, b AS (SELECT trade_date, avg(close) AS benchmark FROM panel GROUP BY 1) SELECT code, trade_date, close / benchmark - 1 AS relative FROM panel JOIN b USING (trade_date)", "relative")
def _(t):
    p = panel(t)
    b = p.groupBy("trade_date").agg(F.avg("close").alias("benchmark"))
    return p.join(b, "trade_date").select("code", "trade_date", (F.col("close") / F.col("benchmark") - 1).alias("relative"))


@query("j19_event_decay", """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), e AS (SELECT user_id, CAST(ts AS DATE) AS ed, value FROM events)
 SELECT d.user_id, d.d, coalesce(sum(value * power(0.5, date_diff('day', ed, d.d) / 5.0)), 0) AS decayed, count(value) AS n_events FROM d LEFT JOIN e ON e.user_id = d.user_id AND date_diff('day', ed, d.d) BETWEEN 0 AND 10 GROUP BY 1, 2""", "decayed", 5)
def _(t):
    e = t.events.select("user_id", F.to_date("ts").alias("ed"), "value")
    return pit.decayed_sum(t.events.select("user_id", F.to_date("ts").alias("d")).distinct(), e, "user_id", "d", "ed", "value", 5.0, 10)


@query("j20_previous_quarter", """WITH q AS (SELECT o_custkey, date_trunc('quarter', o_orderdate) AS q, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)
 SELECT a.o_custkey, a.q, a.v / b.v - 1 AS growth FROM q a JOIN q b ON a.o_custkey = b.o_custkey AND b.q = a.q - INTERVAL 3 MONTH""", "growth")
def _(t):
    q = t.orders.groupBy("o_custkey", F.date_trunc("quarter", "o_orderdate").alias("q")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    b = q.select("o_custkey", F.add_months("q", 3).cast("timestamp").alias("q"), F.col("v").alias("before"))
    return q.join(b, ["o_custkey", "q"]).select("o_custkey", "q", (F.col("v") / F.col("before") - 1).alias("growth"))


@query("j22_lookthrough", """WITH c AS (SELECT l_orderkey, l_suppkey, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS w FROM lineitem)
 SELECT o_custkey, n_name, sum(o_totalprice * w) AS exposure FROM orders JOIN c ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""", "exposure", 3)
def _(t):
    from panelforge.operators.performance import lookthrough

    c = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_suppkey", (F.col("l_extendedprice") / F.sum("l_extendedprice").over(W.partitionBy("l_orderkey"))).alias("constituent_weight"))
    c = c.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return lookthrough(t.orders.select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_totalprice").alias("position_weight")), c, "k", ["o_custkey"], ["n_name"])


@query("j23_fallback_label", "SELECT c_custkey, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END, n_name, 'none') AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    own = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce(own, "n_name", F.lit("none")).alias("label"))


@query("j24_preferred_history", """WITH a AS (SELECT o_custkey AS k, o_orderdate AS d, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), b AS (SELECT o_custkey AS k, o_orderdate AS d, max(o_totalprice) AS v FROM orders GROUP BY 1, 2)
 SELECT b.k, b.d, coalesce(a.v, b.v) AS v FROM b LEFT JOIN a USING (k, d)""")
def _(t):
    a, b = (d.groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("v")) for d in (t.orders.filter("o_orderstatus = 'F'"), t.orders))
    return pit.prefer(a, b, ["k", "d"])


@query("set_operations", """SELECT k, 'both' AS kind FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
 UNION ALL SELECT k, 'only' FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def _(t):
    r, a = (t.lineitem.filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k")) for f in "RA")
    return r.intersect(a).withColumn("kind", F.lit("both")).unionByName(r.subtract(a).withColumn("kind", F.lit("only")))


__all__ = ["UNIVERSE", "universe"]
