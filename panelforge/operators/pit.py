"""Point-in-time joins: exact date, as-of, validity intervals, next session. No row sees later data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def whole_row(df: DataFrame) -> Column:
    """All columns that can be ordered, as the last part of an order: what ties by the others is then settled the same way in every run."""
    return F.struct(*[F.col(f"`{f.name}`") for f in df.schema if not f.dataType.simpleString().startswith("map")])


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the last by `order`, then by the whole row."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*[c.desc() for c in (*order, whole_row(df))]))).filter("__n = 1").drop("__n")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; a second row of a key raises when it is read (many-to-one validation inside the plan)."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return df.withColumn("__n", n).filter(F.when(F.col("__n") > 1, F.raise_error(F.concat_ws(" ", F.lit("duplicate key"), *[F.col(k).cast("string") for k in keys]))).otherwise(F.lit(True))).drop("__n")


def observable(df: DataFrame, as_of: str, columns: tuple[str, ...] = ("observed_at", "ann_date", "source_date", "available_from")) -> DataFrame:
    """Rows whose availability dates, of those columns present, are known and not after as_of."""
    present = [c for c in columns if c in df.columns]
    return reduce(lambda d, c: d.filter(F.col(c).isNotNull() & (F.col(c) <= as_of)), present, df)


def exact_date_join(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Left join on the exact keys; of several right rows the last by `order`; what is missing stays missing."""
    return left.join(keep_last(right, keys, order), keys, "left")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], order: list[Column] | None = None, prefix: str = "", max_age_days: int | None = None, lag_days: int = 0) -> DataFrame:
    """The newest right row of the same `by` with right_time + lag_days <= left_time, as columns `prefix + value`, and `prefix + 'asof'`.

    Both sides go through one shuffle on `by`; the matched row travels as a struct, so a null in it does not
    let an older value through. Ties on time go to the last by `order`. Older than max_age_days: null. Without `by` only the
    distinct times of the left side meet the right one (a series: a row a date), and the left rows join that by time.
    """
    if not by:
        times = left.select(F.col(left_time).alias("__at")).distinct()
        found = _asof(times, right, [], "__at", right_time, values, order, prefix, max_age_days, lag_days)
        return left.join(found, F.col(left_time).eqNullSafe(F.col("__at")), "left").drop("__at")
    return _asof(left, right, by, left_time, right_time, values, order, prefix, max_age_days, lag_days)


def _asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], order: list[Column] | None, prefix: str, max_age_days: int | None, lag_days: int) -> DataFrame:
    when = F.col(right_time) if not lag_days else F.date_add(F.col(right_time), lag_days)
    rank = F.struct(*(order or [F.lit(0)]))
    r = right.select(*by, when.alias("__t"), F.lit(0).alias("__side"), rank.alias("__rank"), F.struct(F.col(right_time).alias("asof"), *values).alias("__row"), F.lit(None).alias("__left"))
    kept = F.struct(*left.columns)
    l = left.select(*by, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__rank"].dataType).alias("__rank"), F.lit(None).cast(r.schema["__row"].dataType).alias("__row"), kept.alias("__left"))
    r = r.withColumn("__left", F.lit(None).cast(l.schema["__left"].dataType))
    w = W.partitionBy(*by).orderBy("__t", "__side", "__rank").rowsBetween(W.unboundedPreceding, 0) if by else W.orderBy("__t", "__side", "__rank").rowsBetween(W.unboundedPreceding, 0)
    out = r.unionByName(l).withColumn("__hit", F.last("__row", ignorenulls=True).over(w)).filter("__side = 1")
    hit = F.col("__hit")
    if max_age_days is not None:
        hit = F.when(F.datediff(F.col("__t"), F.col("__hit.asof")).between(0, max_age_days), hit)
    return out.withColumn("__hit", hit).select("__left.*", F.col("__hit.asof").alias(prefix + "asof"), *[F.col(f"__hit.{v}").alias(prefix + v) for v in values])


def nearest_file(wanted: DataFrame, files: DataFrame, date: str, file_date: str, keys: list[str]) -> DataFrame:
    """The rows of the newest file before each date: files are found by date alone, so a key missing in that file stays missing."""
    dated = asof_join(wanted.withColumn("__before", F.col(date) - F.expr("interval 1 microsecond")), files.select(file_date).distinct(), [], "__before", file_date, []).drop("__before")
    return dated.join(files.withColumnRenamed(file_date, "asof"), ["asof", *keys], "left")


def membership_asof(left: DataFrame, members: DataFrame, by: list[str], time: str, start: str, end: str, value: str) -> DataFrame:
    """Value of the newest member row with start <= time, null if that row's end has passed: an expired newest row hides older ones."""
    joined = asof_join(left, members, by, time, start, [value, end], prefix="m_", order=[F.col(value)])
    live = F.col(f"m_{end}").isNull() | (F.col(time) < F.col(f"m_{end}"))
    return joined.withColumn(value, F.when(live, F.col(f"m_{value}"))).drop("m_asof", f"m_{end}", f"m_{value}")


def interval_join(left: DataFrame, right: DataFrame, by: list[str], time: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Rows of right with start <= time < end (open end: null); the equi key keeps the plan off a nested loop."""
    r = right.select(*[F.col(c).alias(f"__{c}") if c in by else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in by])
    on = on & (F.col(start) <= F.col(time)) & (F.col(end).isNull() | (F.col(time) < F.col(end)))
    return left.join(r, on, how).drop(*[f"__{c}" for c in by])


def sessions(prices: DataFrame, code: str, date: str, name: str = "session") -> DataFrame:
    """prices with the number of each session of its code, from 1."""
    return prices.withColumn(name, F.row_number().over(W.partitionBy(code).orderBy(date)))


def next_session_entry(events: DataFrame, prices: DataFrame, code: str, event_date: str, date: str, horizons: list[int], open_: str = "open", close: str = "close") -> DataFrame:
    """Entry at the first session after the event, exit h sessions on (entry counts as the first): one row an event and horizon, return null without exit."""
    s = sessions(prices.select(code, date, open_, close), code, date)
    w = W.partitionBy(code).orderBy(F.col("__d").desc(), "__kind").rowsBetween(W.unboundedPreceding, 0)
    p = s.select(code, F.col(date).alias("__d"), F.lit(1).alias("__kind"), F.struct(F.col(date).alias("entry_date"), "session", F.col(open_).alias("entry_open")).alias("__p"))
    e = events.select(code, F.col(event_date).alias("__d"), F.lit(0).alias("__kind"), F.struct(*events.columns).alias("__e"))
    both = p.unionByName(e, allowMissingColumns=True)
    hit = both.withColumn("__p", F.last("__p", ignorenulls=True).over(w)).filter("__kind = 0").select("__e.*", "__p.*").filter("session is not null")
    exits = s.select(F.col(code).alias("__c"), F.col("session").alias("__s"), F.col(date).alias("exit_date"), F.col(close).alias("exit_close"))
    each = hit.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("exit_session", F.col("session") + F.col("horizon") - 1)
    return each.join(exits, (F.col(code) == F.col("__c")) & (F.col("exit_session") == F.col("__s")), "left").drop("__c", "__s").withColumn("ret", F.col("exit_close") / F.col("entry_open") - 1)


def outer_compare(primary: DataFrame, secondary: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """Status of each key: matched, mismatch, primary_only, secondary_only, and the fields that differ.

    A value against null differs, null against null does not; tolerances are absolute.
    """
    a = primary.select(*keys, *[F.col(c).alias(f"a_{c}") for c in tolerances], F.lit(True).alias("__a"))
    b = secondary.select(*keys, *[F.col(c).alias(f"b_{c}") for c in tolerances], F.lit(True).alias("__b"))
    differs = [F.when(F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull(), F.lit(c)).when(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > t, F.lit(c)) for c, t in tolerances.items()]
    status = F.when(F.col("__b").isNull(), "primary_only").when(F.col("__a").isNull(), "secondary_only").when(F.col("fields") != "", "mismatch").otherwise("matched")
    return a.join(b, keys, "full_outer").withColumn("fields", F.concat_ws("|", *differs)).withColumn("status", status).withColumn("fields", F.when(F.col("status") == "mismatch", F.col("fields")).otherwise("")).select(*keys, "status", "fields")


def complete_cohort(df: DataFrame, key: list[str], part: str, parts: int) -> DataFrame:
    """Rows of keys that have all `parts` values of `part`."""
    whole = df.groupBy(*key).agg(F.count_distinct(part).alias("__n")).filter(F.col("__n") == parts).select(*key)
    return df.join(whole, key, "left_semi")


def prefer(preferred: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key; where both have a key the preferred row stays, of several the least."""
    both = preferred.withColumn("__p", F.lit(0)).unionByName(other.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy("__p", whole_row(both)))).filter("__n = 1").drop("__n", "__p")


def decayed_sum(rows: DataFrame, events: DataFrame, code: str, time: str, event_time: str, weight: str, half_life_days: float, max_age_days: int) -> DataFrame:
    """Per row the sum of event weights x 0.5^(age / half life) over the code's events of age 0..max_age_days, and their number.

    Events meet rows by code and by time slot of max_age_days (an event goes to its own and the next slot), so a
    code with very many dates and events is not one task's nested loop.
    """
    slot = lambda c: F.floor(F.unix_date(F.to_date(c)) / (max_age_days + 1))
    r = rows.withColumn("__slot", slot(F.col(time)))
    e = events.select(F.col(code).alias("__code"), F.col(event_time).alias("__et"), F.col(weight).alias("__w"), F.explode(F.array(slot(F.col(event_time)), slot(F.col(event_time)) + 1)).alias("__eslot"))
    age = F.datediff(F.col(time), F.col("__et"))
    joined = r.join(e, (F.col(code) == F.col("__code")) & (F.col("__slot") == F.col("__eslot")) & age.between(0, max_age_days), "left")
    value = F.col("__w") * F.pow(F.lit(0.5), age / half_life_days)
    return joined.groupBy(*rows.columns).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("decayed"), F.count("__w").alias("n_events"))


def filtered_or_relaxed(df: DataFrame, by: list[str], hard: Column, relaxed: Column) -> DataFrame:
    """Rows that pass the hard rule; in groups where none does, those that pass the relaxed one. `rule` says which."""
    d = df.withColumn("__hard", F.coalesce(hard, F.lit(False)))
    some = F.max(F.col("__hard").cast("int")).over(W.partitionBy(*by)) == 1
    d = d.withColumn("rule", F.when(some, "hard").otherwise("relaxed"))
    return d.filter(F.when(F.col("rule") == "hard", F.col("__hard")).otherwise(F.coalesce(relaxed, F.lit(False)))).drop("__hard")
