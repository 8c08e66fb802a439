"""Scores of extracted events, policy exposure, coverage, fund restrictions and the sentiment ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.scalar import col, truth

#: Parts of an event's scores.
OTHER_ROLES = ("holder", "counterparty", "target", "authority", "new_controller")
ADVANCED = ("approved", "completed")


def bounded(x: Column, low: float = 0.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(1.0))


def relevance(roles: str | Column, first_page: str | Column, evidence: str | Column) -> Column:
    """Role, place and evidence of an event in its document; roles is an array."""
    r = col(roles)
    role = F.when(F.array_contains(r, "issuer"), 0.55).otherwise(0.30) + F.when(F.arrays_overlap(r, F.array(*map(F.lit, OTHER_ROLES))), 0.10).otherwise(0.0)
    place = F.when(col(first_page) <= 1, 0.25).when(col(first_page) <= 3, 0.18).otherwise(0.10)
    return bounded(role + place + F.least(F.lit(0.20), F.greatest(col(evidence), F.lit(0)) * 0.10))


def looked_up(key: str | Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for name, value in table.items():
        out = F.when(col(key) == name, value).otherwise(out)
    return out


def covered_share(validated: str | Column, required: str | Column) -> Column:
    return F.when(col(required) > 0, bounded(col(validated) / col(required))).otherwise(0.0)


def rule_direction(rule: str | Column, lifecycle: str | Column, action: str | Column, growth: str | Column, negative: list[str]) -> Column:
    """Direction from -1 to 1 that a rule gives an event at its stage."""
    r, stage, act = col(rule), col(lifecycle), F.lower(F.coalesce(col(action), F.lit("")))
    done = stage.isin(*ADVANCED)
    change = F.when(act.rlike("decrease|sell|减持|出售"), -0.80).when(act.rlike("increase|buy|增持|买入"), 0.80).otherwise(0.0)
    return (
        F.when(stage == "cancelled", -0.75)
        .when(r == "shareholder_net_change_v1", change)
        .when(r.isin("earnings_forecast_midpoint_growth_v1", "earnings_flash_profit_growth_v1"), F.coalesce(bounded(col(growth) * 5, -1.0), F.lit(0.0)))
        .when(r == "control_change_completion_financing_v1", F.when(stage == "completed", 0.55).otherwise(0.15))
        .when(r == "restructuring_lifecycle_dilution_v1", F.when(done, 0.45).otherwise(0.10))
        .when(r.isin(*negative), F.when(done, -0.85).otherwise(-0.65))
        .otherwise(F.when(done, 0.65).otherwise(0.45))
    )


def event_scores(df: DataFrame, stages: dict[str, float], sources: dict[str, float], negative: list[str]) -> DataFrame:
    """relevance, certainty, source_credibility, direction and confidence of validated events.

    df: roles, first_page, evidence, validated, required, lifecycle, source, rule, action, growth.
    """
    share = covered_share("validated", "required")
    d = df.withColumn("__share", share).withColumn("relevance", relevance("roles", "first_page", "evidence"))
    d = d.withColumn("certainty", bounded(looked_up("lifecycle", stages, 0.40) * F.col("__share"))).withColumn("source_credibility", looked_up("source", sources, 0.40))
    d = d.withColumn("direction", rule_direction("rule", "lifecycle", "action", "growth", negative))
    return d.withColumn("confidence", bounded(0.45 * F.col("__share") + 0.20 * F.col("certainty") + 0.20 * F.col("source_credibility") + 0.15 * F.col("relevance"))).drop("__share")


def policy_exposure(rows: DataFrame, events: DataFrame, date: str, industry: str, window: int = 60, half_life: float = 20.0) -> DataFrame:
    """rows with policy_exposure: decayed direction x strength x confidence of policy events up to `window` days old, general ones and those
    of the row's industry; null where none applies. events: event_date, weight, industry (null or blank: general).

    Scores are summed per date (and industry) over a table of dates, so rows only look them up.
    """
    dates = rows.select(F.col(date).alias("__d")).distinct()
    day = F.explode(F.sequence(F.col("event_date"), F.date_add("event_date", window)))
    e = events.filter(F.col("event_date").isNotNull()).withColumn("__d", day).withColumn("__v", F.col("weight") * F.pow(F.lit(0.5), F.datediff("__d", "event_date") / half_life))
    blank = F.coalesce(F.trim("industry"), F.lit("")) == ""
    e = e.groupBy("__d", F.when(~blank, F.col("industry")).alias("__i")).agg(F.sum("__v").alias("__v")).join(dates, "__d", "left_semi")
    general = e.filter("__i is null").select(F.col("__d").alias(date), F.col("__v").alias("__g"))
    own = e.filter("__i is not null").select(F.col("__d").alias(date), F.col("__i").alias(industry), F.col("__v").alias("__o"))
    d = rows.join(general, date, "left").join(own, [date, industry], "left")
    some = F.col("__g").isNotNull() | F.col("__o").isNotNull()
    return d.withColumn("policy_exposure", F.when(some, F.coalesce("__g", F.lit(0.0)) + F.coalesce("__o", F.lit(0.0)))).drop("__g", "__o")


def semantic_coverage(rows: DataFrame, processed: DataFrame, code: str, date: str) -> DataFrame:
    """`covered` from the first date on which a document of the code was fully processed. processed: code, available (date)."""
    first = processed.filter(F.col("available").isNotNull()).groupBy(code).agg(F.min("available").alias("__first"))
    return rows.join(first, code, "left").withColumn("covered", truth(F.col("__first") <= F.col(date)).cast("int")).drop("__first")


def fund_restrictions(events: DataFrame, as_of, code: str = "code") -> DataFrame:
    """Active restrictions at as_of: (code, event_id, scope, status): permanent (confirmed termination), confirmed or unconfirmed.

    events: code, event_id, event_type, scope, effective (and published, observed), valid_to, hard_block, clears, resume_of, confirmed.
    A clear that takes effect later lifts blocks of its scopes and the block it resumes; purchase_redemption stands for both scopes.
    Blocks that have expired do not count; a permanent one is never lifted.
    """
    seen = events.filter((F.col("published") <= as_of) & (F.col("observed") <= as_of) & (F.col("effective") <= as_of))
    scope = F.lower(F.trim(F.coalesce("scope", F.lit(""))))
    seen = seen.withColumn("scope", F.explode(F.when(scope == "purchase_redemption", F.array(F.lit("purchase"), F.lit("redemption"))).otherwise(F.array(F.when(scope == "", "unspecified").otherwise(scope)))))
    order = F.struct("effective", "observed", "event_id")
    blocks = seen.filter(truth(F.col("hard_block")) & (F.col("valid_to").isNull() | (F.col("valid_to") >= as_of))).withColumn("__o", order)
    permanent = blocks.filter(truth(F.col("confirmed")) & (F.col("event_type") == "termination"))
    clears = seen.filter(truth(F.col("clears")))
    lifted = clears.groupBy(code, "scope").agg(F.max(order).alias("__c"))
    resumed = clears.filter(F.col("resume_of").isNotNull()).groupBy(code, F.col("resume_of").alias("event_id")).agg(F.max(order).alias("__r"))
    open_ = blocks.filter(~(truth(F.col("confirmed")) & (F.col("event_type") == "termination"))).join(lifted, [code, "scope"], "left").join(resumed, [code, "event_id"], "left")
    open_ = open_.filter(~truth(F.col("__c") > F.col("__o")) & ~truth(F.col("__r") > F.col("__o")))
    status = F.when(truth(F.col("confirmed")), "confirmed").otherwise("unconfirmed")
    return permanent.select(code, "event_id", "scope", F.lit("permanent").alias("status")).unionByName(open_.select(code, "event_id", "scope", status.alias("status"))).distinct()


def sentiment_ledger(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing records and the new ones whose key is not there: a second record of a key is rejected, the first of several new ones (by value) stays."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, "__r.*")
    return existing.unionByName(first.join(existing.select(*keys), keys, "left_anti"))


def latest_sentiment(ledger: DataFrame, by: list[str], date: str, as_of) -> DataFrame:
    """The newest record of each `by` on or before as_of."""
    return ledger.filter(F.col(date) <= as_of).withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(F.col(date).desc()))).filter("__n = 1").drop("__n")


def lifecycle_actions(df: DataFrame, code: str, date: str, stage: str, amount: str, families: dict[str, str]) -> DataFrame:
    """Repurchases by lifecycle family: amounts of a code, date and family summed (null if none is known); stages without a family are left out."""
    family = F.lit(None).cast("string")
    for name, value in families.items():
        family = F.when(F.col(stage) == name, value).otherwise(family)
    return df.withColumn("family", family).filter("family is not null").groupBy(code, date, "family").agg(F.sum(amount).alias("amount"))


def source_features(daily: DataFrame, flow: DataFrame, code: str, date: str, rate: str, ranked: list[str], net: str) -> DataFrame:
    """A row a code: latest values and their percentile, change of the rate from the first row to the last, latest net flow and the share of
    positive flows among the last five."""
    g = daily.groupBy(code).agg(F.max_by(F.struct(rate, *ranked), date).alias("__l"), F.min_by(rate, date).alias("__first"), F.count(rate).alias("__n"))
    d = g.select(code, "__l.*", F.when((F.col("__n") > 1) & (F.col("__first") != 0), F.col(f"__l.{rate}") / F.col("__first") - 1).alias(f"{rate}_change"))
    for c in ranked:
        long = W.partitionBy(F.col(c).isNull())
        d = d.withColumn(f"{c}_percentile", F.when(F.col(c).isNotNull(), (F.rank().over(long.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(c)) - 1) / 2) / F.count(c).over(long)))
    f = flow.withColumn("__i", F.row_number().over(W.partitionBy(code).orderBy(F.col(date).desc()))).filter("__i <= 5")
    f = f.groupBy(code).agg(F.max(F.when(F.col("__i") == 1, F.col(net))).alias("flow_net_large"), F.avg(truth(F.col(net) > 0).cast("double")).alias("flow_persistence_5"))
    return d.join(f, code, "left")
