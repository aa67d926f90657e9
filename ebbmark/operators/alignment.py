"""Calendars, as-of alignment of mixed frequencies, and reconciliation against known figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbmark.core.windows import KEY
from ebbmark.functions import blocked

#: Days after which an observation no longer stands in for later ones.
STALE_AFTER = {"daily": 7, "weekly": 21, "monthly": 60}


def business_days(spans: DataFrame) -> DataFrame:
    """Rows of spans(..., lo, hi) exploded to the Mondays to Fridays from lo to hi, as ``date``."""
    days = spans.withColumn("date", F.explode(F.sequence("lo", "hi"))).filter(F.dayofweek("date").between(2, 6))
    return days.drop("lo", "hi")


def as_of(obs: DataFrame, calendar: DataFrame, limit_days: int, size: int = blocked.ROWS) -> DataFrame:
    """(entity_id, series_id, date, value, as_of): the last value known on each calendar date.

    obs(entity_id, series_id, date, knowable_from, value) counts from knowable_from on and drops out
    once its knowable_from is older than the limit. Observations and calendar rows are one ordered
    stream per series, so this is one shuffle and no range join; of observations known on one day the
    latest date wins. Streams of more than ``size`` rows are filled in blocks: the last observation of
    each block is carried into the blocks after it.
    """
    last = F.struct("value", F.col("date").alias("as_of"), F.col("knowable_from").alias("known"))
    rows = obs.filter("value is not null").select(*KEY, F.col("knowable_from").alias("day"), F.lit(0).alias("kind"), F.col("date").alias("as_of"), last.alias("last"))
    empty = dict(rows.dtypes)["last"]
    days = calendar.select(*KEY, F.col("date").alias("day"), F.lit(1).alias("kind"), F.lit(None).cast("date").alias("as_of"), F.lit(None).cast(empty).alias("last"))
    order = ("day", "kind", "as_of")
    short, long, _ = blocked.by_length(rows.unionByName(days), KEY, size)
    past = Window.partitionBy(*KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = short.withColumn("last", F.last("last", ignorenulls=True).over(past))
    if long is not None:
        filled = filled.unionByName(blocked.last_known(blocked.indexed(long, KEY, order, size), KEY, "last", size).drop("at"))
    fresh = F.datediff("day", "last.known") <= limit_days
    return filled.filter("kind = 1").select(*KEY, F.col("day").alias("date"), F.when(fresh, F.col("last.value")).alias("value"), F.when(fresh, F.col("last.as_of")).alias("as_of"))


def complete_pairs(a: DataFrame, b: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Inner equi-join without rows where one of the values is null."""
    return a.join(b, on).dropna(subset=values)


def reconciled(truth: DataFrame, found: DataFrame, tolerance: float = 0.0001) -> DataFrame:
    """truth(role, as_of, expected, must_match) with result: match, mismatch, missing or date_mismatch, and passed.

    A match is within ``tolerance`` of the expected figure, or within 1 of zero. A negative control has
    must_match false and passes when it does not match. found(role, as_of, actual) has one row per role.
    """
    both = truth.join(found.select("role", F.col("as_of").alias("found_as_of"), "actual"), "role", "left")
    near = F.when(F.col("expected") == 0, F.abs("actual") < 1).otherwise(F.abs(F.col("actual") - F.col("expected")) / F.abs("expected") <= tolerance)
    result = F.when(F.col("actual").isNull(), "missing").when(F.col("found_as_of") != F.col("as_of"), "date_mismatch").when(near, "match").otherwise("mismatch")
    return both.withColumn("result", result).withColumn("passed", (F.col("result") == "match") == F.col("must_match"))


def reconciliation_summary(checked: DataFrame, least: int = 3) -> DataFrame:
    """(result, n) of the rows that must match, with ``enough``: whether at least ``least`` matched."""
    by = checked.filter("must_match").groupBy("result").agg(F.count("*").alias("n"))
    return by.withColumn("enough", F.coalesce(F.max(F.when(F.col("result") == "match", F.col("n"))).over(Window.partitionBy(F.lit(1))), F.lit(0)) >= least)
