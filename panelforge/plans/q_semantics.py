"""Event scores, policy exposure, coverage, fund restrictions, sentiment and source features as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.scalar import code_key
from panelforge.operators import semantics
from panelforge.plans.base import MEMBERS, PANEL, members, panel, query

STAGES = {"planned": 0.5, "approved": 0.8, "completed": 1.0}
SOURCES = {"exchange": 1.0, "newswire": 0.7}
FOUND = """found AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN ['issuer', 'holder'] WHEN '2-HIGH' THEN ['issuer'] WHEN '3-MEDIUM' THEN ['target'] ELSE ['other'] END AS roles, o_orderkey % 5 AS page, o_orderkey % 4 AS evidence, o_orderkey % 6 AS validated, o_custkey % 6 AS required,
 CASE o_orderkey % 4 WHEN 0 THEN 'planned' WHEN 1 THEN 'approved' WHEN 2 THEN 'completed' ELSE 'cancelled' END AS stage, CASE o_orderstatus WHEN 'F' THEN 'exchange' WHEN 'O' THEN 'newswire' ELSE 'forum' END AS source,
 CASE o_custkey % 7 WHEN 0 THEN 'shareholder_net_change_v1' WHEN 1 THEN 'earnings_flash_profit_growth_v1' WHEN 2 THEN 'control_change_completion_financing_v1' WHEN 3 THEN 'restructuring_lifecycle_dilution_v1' WHEN 4 THEN 'penalty_v1' ELSE 'contract_v1' END AS rule, CASE o_orderkey % 3 WHEN 0 THEN 'Share Decrease' WHEN 1 THEN '增持计划' END AS action, (o_totalprice - 200000) / 400000 AS growth FROM orders)"""


def found(t):
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    arr = lambda *x: F.array(*map(F.lit, x))
    roles = F.when(p == "1-URGENT", arr("issuer", "holder")).when(p == "2-HIGH", arr("issuer")).when(p == "3-MEDIUM", arr("target")).otherwise(arr("other"))
    stage = F.element_at(arr("planned", "approved", "completed", "cancelled"), (k % 4 + 1).cast("int"))
    source = F.when(F.col("o_orderstatus") == "F", "exchange").when(F.col("o_orderstatus") == "O", "newswire").otherwise("forum")
    rule = F.element_at(arr("shareholder_net_change_v1", "earnings_flash_profit_growth_v1", "control_change_completion_financing_v1", "restructuring_lifecycle_dilution_v1", "penalty_v1", "contract_v1", "contract_v1"), (c % 7 + 1).cast("int"))
    action = F.when(k % 3 == 0, "Share Decrease").when(k % 3 == 1, "增持计划")
    return t.orders.select(k.alias("id"), roles.alias("roles"), (k % 5).alias("first_page"), (k % 4).alias("evidence"), (k % 6).alias("validated"), (c % 6).alias("required"), stage.alias("lifecycle"), source.alias("source"), rule.alias("rule"), action.alias("action"), ((F.col("o_totalprice") - 200000) / 400000).alias("growth"))


@query("d9_event_scores", f"""WITH {FOUND}, s AS (SELECT *, CASE WHEN required > 0 THEN least(greatest(validated / required, 0), 1) ELSE 0 END AS share, least(CASE WHEN list_contains(roles, 'issuer') THEN 0.55 ELSE 0.30 END + CASE WHEN list_has_any(roles, ['holder', 'counterparty', 'target', 'authority', 'new_controller']) THEN 0.10 ELSE 0 END + CASE WHEN page <= 1 THEN 0.25 WHEN page <= 3 THEN 0.18 ELSE 0.10 END + least(0.20, evidence * 0.10), 1) AS relevance,
 CASE source WHEN 'exchange' THEN 1.0 WHEN 'newswire' THEN 0.7 ELSE 0.40 END AS source_credibility, CASE stage WHEN 'planned' THEN 0.5 WHEN 'approved' THEN 0.8 WHEN 'completed' THEN 1.0 ELSE 0.40 END AS sure,
 CASE WHEN stage = 'cancelled' THEN -0.75 WHEN rule = 'shareholder_net_change_v1' THEN CASE WHEN action LIKE '%Decrease%' THEN -0.80 WHEN action LIKE '%增持%' THEN 0.80 ELSE 0 END WHEN rule = 'earnings_flash_profit_growth_v1' THEN least(greatest(growth * 5, -1), 1) WHEN rule = 'control_change_completion_financing_v1' THEN CASE WHEN stage = 'completed' THEN 0.55 ELSE 0.15 END
  WHEN rule = 'restructuring_lifecycle_dilution_v1' THEN CASE WHEN stage IN ('approved', 'completed') THEN 0.45 ELSE 0.10 END WHEN rule = 'penalty_v1' THEN CASE WHEN stage IN ('approved', 'completed') THEN -0.85 ELSE -0.65 END ELSE CASE WHEN stage IN ('approved', 'completed') THEN 0.65 ELSE 0.45 END END AS direction FROM found)
 SELECT id, CAST(relevance AS DOUBLE) AS relevance, CAST(sure * share AS DOUBLE) AS certainty, CAST(source_credibility AS DOUBLE) AS source_credibility, CAST(direction AS DOUBLE) AS direction, CAST(least(0.45 * share + 0.20 * sure * share + 0.20 * source_credibility + 0.15 * relevance, 1) AS DOUBLE) AS confidence FROM s""", "relevance certainty source_credibility direction confidence", 5)
def _(t):
    d = semantics.event_scores(found(t), STAGES, SOURCES, ["penalty_v1"])
    return d.select("id", "relevance", "certainty", "source_credibility", "direction", "confidence")


@query("d12_policy_exposure", f"""WITH {PANEL}, {MEMBERS}, r AS (SELECT code, industry, CAST(strptime(trade_date, '%Y%m%d') AS DATE) AS d FROM panel JOIN members USING (code)), e AS (SELECT CAST(o_orderdate AS DATE) AS d, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE n_name END AS industry, CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE -0.3 END AS w FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 40 = 0),
 x AS (SELECT r.d, e.industry, sum(w * power(0.5, date_diff('day', e.d, r.d) / 20.0)) AS v FROM (SELECT DISTINCT d FROM r) r JOIN e ON r.d >= e.d AND date_diff('day', e.d, r.d) <= 60 GROUP BY 1, 2)
 SELECT code, r.d, CASE WHEN g.v IS NOT NULL OR o.v IS NOT NULL THEN coalesce(g.v, 0) + coalesce(o.v, 0) END AS policy_exposure FROM r LEFT JOIN x g ON g.d = r.d AND g.industry IS NULL LEFT JOIN x o ON o.d = r.d AND o.industry = r.industry""", "policy_exposure", 5)
def _(t):
    rows = panel(t).join(members(t), "code").select("code", "industry", F.to_date("trade_date", "yyyyMMdd").alias("d"))
    o = t.orders.filter("o_orderkey % 40 = 0").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    e = o.select(F.to_date("o_orderdate").alias("event_date"), F.when(F.col("o_custkey") % 3 != 0, F.col("n_name")).alias("industry"), F.when(F.col("o_orderkey") % 2 == 0, 0.5).otherwise(-0.3).alias("weight"))
    return semantics.policy_exposure(rows, e, "d", "industry").select("code", "d", "policy_exposure")


@query("d13_semantic_coverage", f"""WITH {PANEL}, f AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code, min(CAST(o_orderdate AS DATE)) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT code, trade_date, CAST(coalesce(first <= CAST(strptime(trade_date, '%Y%m%d') AS DATE), false) AS INTEGER) AS covered FROM panel LEFT JOIN f USING (code)""")
def _(t):
    done = t.orders.filter("o_orderstatus = 'F'").select(code_key(F.col("o_custkey")).alias("code"), F.to_date("o_orderdate").alias("available"))
    rows = panel(t).select("code", "trade_date", F.to_date("trade_date", "yyyyMMdd").alias("d"))
    return semantics.semantic_coverage(rows, done, "code", "d").select("code", "trade_date", "covered")


CUT = "TIMESTAMP '2024-01-20'"
FUND_EVENTS = """fe AS (SELECT user_id AS code, event_id, CASE event_type WHEN 'refund' THEN 'termination' ELSE 'limit' END AS event_type, CASE event_id % 4 WHEN 0 THEN 'purchase' WHEN 1 THEN 'redemption' WHEN 2 THEN 'purchase_redemption' END AS scope, ts AS effective, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 3 DAY END AS valid_to, event_type <> 'click' AS hard_block, event_type = 'click' AS clears, CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN event_id - 7 END AS resume_of, event_id % 2 = 0 AS confirmed FROM events)"""


@query("d16_fund_restrictions", f"""WITH {FUND_EVENTS}, s AS (SELECT *, unnest(CASE scope WHEN 'purchase_redemption' THEN ['purchase', 'redemption'] ELSE [coalesce(scope, 'unspecified')] END) AS sc FROM fe WHERE effective <= {CUT}), b AS (SELECT * FROM s WHERE hard_block AND (valid_to IS NULL OR valid_to >= {CUT})), c AS (SELECT * FROM s WHERE clears)
 SELECT DISTINCT code, event_id, sc AS scope, CASE WHEN confirmed AND event_type = 'termination' THEN 'permanent' WHEN confirmed THEN 'confirmed' ELSE 'unconfirmed' END AS status FROM b WHERE (confirmed AND event_type = 'termination') OR NOT EXISTS (SELECT 1 FROM c WHERE c.code = b.code AND (c.sc = b.sc OR c.resume_of = b.event_id) AND (c.effective > b.effective OR (c.effective = b.effective AND c.event_id > b.event_id)))""")
def _(t):
    k, kind = F.col("event_id"), F.col("event_type")
    scope = F.when(k % 4 == 0, "purchase").when(k % 4 == 1, "redemption").when(k % 4 == 2, "purchase_redemption")
    e = t.events.select(F.col("user_id").alias("code"), k, F.when(kind == "refund", "termination").otherwise("limit").alias("event_type"), scope.alias("scope"), F.col("ts").alias("effective"), F.col("ts").alias("published"), F.col("ts").alias("observed"), F.when(k % 5 == 0, F.col("ts") + F.expr("interval 3 days")).alias("valid_to"), (kind != "click").alias("hard_block"), (kind == "click").alias("clears"), F.when((kind == "click") & (k % 3 == 0), k - 7).alias("resume_of"), (k % 2 == 0).alias("confirmed"))
    return semantics.fund_restrictions(e, F.lit("2024-01-20").cast("timestamp_ntz"))


@query("d18_sentiment_ledger", """WITH l AS (SELECT event_type AS sector, CAST(date_trunc('week', ts) AS DATE) AS week_end, min(value) FILTER (WHERE event_id % 2 = 0) AS a, min(value) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY 1, 2), k AS (SELECT sector, week_end, coalesce(a, b) AS score FROM l)
 SELECT sector, week_end, score FROM k WHERE week_end <= DATE '2024-01-20' QUALIFY row_number() OVER (PARTITION BY sector ORDER BY week_end DESC) = 1""", "score")
def _(t):
    e = t.events.select(F.col("event_type").alias("sector"), F.to_date(F.date_trunc("week", "ts")).alias("week_end"), F.col("value").alias("score"), "event_id")
    old = e.filter("event_id % 2 = 0").groupBy("sector", "week_end").agg(F.min("score").alias("score"))
    ledger = semantics.sentiment_ledger(old, e.filter("event_id % 2 = 1").select("sector", "week_end", "score"), ["sector", "week_end"])
    return semantics.latest_sentiment(ledger, ["sector"], "week_end", F.lit("2024-01-20").cast("date"))


FAMILIES = {"F": "repurchase_completed", "O": "repurchase_plan"}


@query("a9_lifecycle_actions", "SELECT o_custkey AS code, strftime(o_orderdate, '%Y%m') AS d, CASE o_orderstatus WHEN 'F' THEN 'repurchase_completed' ELSE 'repurchase_plan' END AS family, round(sum(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END), 2) AS amount FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2, 3", "amount", 2)
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("code"), F.date_format("o_orderdate", "yyyyMM").alias("d"), "o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("amount"))
    return semantics.lifecycle_actions(o, "code", "d", "o_orderstatus", "amount", FAMILIES)


@query("a5_source_features", f"""WITH {PANEL}, d AS (SELECT code, arg_max(close, trade_date) AS close, arg_max(volume, trade_date) AS volume, arg_min(volume, trade_date) AS first, count(*) AS n FROM panel GROUP BY 1), f AS (SELECT code, CASE WHEN volume % 2 = 0 THEN amount ELSE -amount END AS net, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS i FROM panel),
 g AS (SELECT code, max(CASE WHEN i = 1 THEN net END) AS flow_net_large, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) AS flow_persistence_5 FROM f WHERE i <= 5 GROUP BY 1)
 SELECT code, volume, close, CASE WHEN n > 1 AND first <> 0 THEN volume / first - 1 END AS volume_change, (rank() OVER (ORDER BY close) + (count(*) OVER (PARTITION BY close) - 1) / 2.0) / count(*) OVER () AS close_percentile, flow_net_large, flow_persistence_5 FROM d JOIN g USING (code)""", "volume close volume_change close_percentile flow_net_large flow_persistence_5")
def _(t):
    p = panel(t)
    flow = p.select("code", "trade_date", F.when(F.col("volume") % 2 == 0, F.col("amount")).otherwise(-F.col("amount")).alias("net"))
    return semantics.source_features(p, flow, "code", "trade_date", "volume", ["close"], "net")
