"""Percentile-rank triggers: rank against the own past, hinge, fired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbmark.core.windows import KEY, expanding, rolling
from ebbmark.functions import blocked, grouped


def causal_rank(obs: DataFrame, window: int | None = None, min_periods: int = 252, long_series: bool = True, size: int = blocked.ROWS) -> DataFrame:
    """(entity_id, series_id, date, rank): the share of the window that is <= the current value.

    Null values are removed first, so windows count observations. Ranks of long series come from numpy
    helpers, in blocks of ``size`` rows; ``long_series=False`` uses frames, which hold the window on every row.
    """
    rows = obs.filter("value is not null").select(*KEY, "date", "value")
    least = min_periods if window is None else min(min_periods, window)
    if long_series:
        return grouped.past_rank(rows, window, least, size=size).select(*KEY, "date", "rank")
    over = expanding() if window is None else rolling(window)
    seen = rows.withColumn("xs", F.collect_list("value").over(over))
    share = F.size(F.filter("xs", lambda x: x <= F.col("value"))) / F.size("xs")
    return seen.select(*KEY, "date", F.when(F.size("xs") >= least, share).alias("rank"))


def hinge(rank: Column, rule: Column, pct: Column) -> Column:
    """How far beyond the threshold, in [0, 1]; null stays null."""
    p = pct / 100
    far = F.when(rule == "gt", (rank - p) / (1 - p)).otherwise((p - rank) / p)
    return F.when(rank.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), far)))


def fired(rank: Column, rule: Column, pct: Column) -> Column:
    """Whether the rank is at or beyond the threshold; null stays null."""
    return F.when(rule == "gt", rank >= pct / 100).otherwise(rank <= pct / 100)


def checked_rules(rules: DataFrame) -> DataFrame:
    """The small rules table, after failing on an unknown rule, a percentile outside (0, 100) or a repeat."""
    if bad := rules.filter("rule not in ('gt', 'lt') or pct <= 0 or pct >= 100 or rule is null or pct is null").select("input_id").limit(5).collect():
        raise ValueError(f"rules must be gt or lt with 0 < pct < 100: {[r[0] for r in bad]}")
    if bad := rules.groupBy("input_id", "side").count().filter("count > 1").select("input_id").limit(5).collect():
        raise ValueError(f"inputs have more than one rule for a side: {[r[0] for r in bad]}")
    return rules


def published_denominator(rules: DataFrame) -> DataFrame:
    return rules.groupBy("side").agg(F.count("*").alias("n_inputs"))
