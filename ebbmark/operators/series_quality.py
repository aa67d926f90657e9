"""Which series are usable: profiles, statuses, resolution of candidates to inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_AFTER = {"daily": 7, "weekly": 21, "monthly": 60}


def frequency(gap: Column) -> Column:
    return F.when(gap <= 2, "daily").when(gap <= 10, "weekly").when(gap <= 45, "monthly").when(gap.isNotNull(), "quarterly_or_sparser")


def profile(obs: DataFrame, key: list[str], today, mean_gap: bool = False) -> DataFrame:
    """Per series: points, first and last date, history, staleness, last value, gap and frequency.

    The gap is the exact median of day differences of more than five points, or their mean. One
    ordered pass by key, then one group-by on the same key.
    """
    rows = obs.filter("value is not null").select(*key, "date", "value")
    gaps = rows.withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy(*key).orderBy("date"))))
    gap = F.datediff(F.max("date"), F.min("date")) / F.nullif(F.count("*") - 1, F.lit(0)) if mean_gap else F.percentile("gap", F.lit(0.5))
    by = gaps.groupBy(*key).agg(
        F.count("*").alias("points"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max_by("value", "date").alias("last_value"),
        F.when(F.count("*") > 5, gap).alias("gap_days"),
    )
    return by.withColumns(
        {
            "history_years": F.round(F.datediff("last_date", "first_date") / 365.25, 2),
            "staleness_days": F.datediff(F.lit(today), "last_date"),
            "inferred_frequency": frequency(F.col("gap_days")),
        }
    )


def status(candidates: DataFrame, errors: DataFrame, least_years: float) -> DataFrame:
    """candidates(ticker, field, frequency, profile columns) with ``status``; errors(ticker, field, kind, category).

    In order: security error, field error (denied or invalid) without points, reference-call exception
    without points, no data, stale by the frequency's limit, short history, ok.
    """
    denied = F.upper("category").rlike("AUTH|ENTITL|PERMISSION")
    ref_denied = F.upper("category").rlike("AUTH|ENTITL")
    by = errors.groupBy("ticker", "field").agg(
        F.bool_or(F.col("kind") == "security").alias("security"),
        F.bool_or(F.col("kind") == "field").alias("on_field"),
        F.bool_or((F.col("kind") == "field") & denied).alias("denied"),
        F.bool_or(F.col("kind") == "reference").alias("on_reference"),
        F.bool_or((F.col("kind") == "reference") & ref_denied).alias("ref_denied"),
    )
    limit = F.lit(STALE_AFTER["monthly"])
    for name, days in STALE_AFTER.items():
        limit = F.when(F.col("frequency") == name, days).otherwise(limit)
    none = F.coalesce("points", F.lit(0)) == 0
    said = (
        F.when(F.col("security"), "INVALID_TICKER")
        .when(F.col("on_field") & none, F.when(F.col("denied"), "FIELD_DENIED").otherwise("FIELD_INVALID"))
        .when(F.col("on_reference") & none, F.when(F.col("ref_denied"), "FIELD_DENIED").otherwise("FIELD_INVALID"))
        .when(none, "NO_DATA")
        .when(F.col("staleness_days") > limit, "STALE")
        .when(F.col("history_years") < least_years, "OK_SHORT_HISTORY")
        .otherwise("OK")
    )
    return candidates.join(by, ["ticker", "field"], "left").withColumn("status", said).drop("security", "on_field", "denied", "on_reference", "ref_denied")


def usable(status: Column) -> Column:
    return status.isin("OK", "OK_SHORT_HISTORY")


def first_by(rows: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key; which, is settled before the shuffle by map-side minima of the rest."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*(F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)))).alias("x"))
    return best.select(*key, "x.*")


def best_field(tried: DataFrame) -> DataFrame:
    """Per (input_id, role, candidate): the first usable field in listed order, else the first tried."""
    return first_by(tried, ["input_id", "role", "candidate"], ~usable(F.col("status")), "field_position")


def resolved(candidates: DataFrame) -> DataFrame:
    """(input_id, role, basket, tickers, satisfied): the first usable ticker, or all of a basket (two at least).

    candidates(input_id, role, basket, candidate, position, status), one row per candidate.
    """
    good = usable(F.col("status"))
    by = candidates.groupBy("input_id", "role", "basket").agg(F.array_sort(F.collect_list(F.when(good, F.struct("position", "candidate")))).alias("x"))
    names = F.transform("x", lambda s: s["candidate"])
    return by.select("input_id", "role", "basket", F.when(F.col("basket"), names).otherwise(F.slice(names, 1, 1)).alias("tickers"), (F.size("x") >= F.when(F.col("basket"), 2).otherwise(1)).alias("satisfied"))


def verdicts(roles: DataFrame) -> DataFrame:
    """(input_id, verdict): BUILDABLE if all roles are satisfied, PARTIAL if some, else BLOCKED."""
    by = roles.groupBy("input_id").agg(F.bool_and("satisfied").alias("every"), F.bool_or("satisfied").alias("some"))
    return by.select("input_id", F.when(F.col("every"), "BUILDABLE").when(F.col("some"), "PARTIAL").otherwise("BLOCKED").alias("verdict"))


def verdict_counts(judged: DataFrame) -> DataFrame:
    """(verdict, n) over all inputs of verdicts()."""
    return judged.groupBy("verdict").agg(F.count("*").alias("n"))


def distinct_tickers(candidates: DataFrame) -> DataFrame:
    """(ticker): every candidate once, blank ones left out: what has to be asked for."""
    return candidates.select(F.trim("candidate").alias("ticker")).filter("ticker <> ''").distinct()


def longest(series: DataFrame, key: list[str], k: int = 4) -> DataFrame:
    """The k rows of most ``n`` per key, ties by code, with ``place``."""
    over = Window.partitionBy(*key).orderBy(F.desc("n"), "code")
    return series.withColumn("place", F.row_number().over(over)).filter(F.col("place") <= k)


def first_passing(variants: DataFrame, key: list[str]) -> DataFrame:
    """Every key with the id of its first passing variant(id, rung, passed), null if none passes."""
    return variants.groupBy(*key).agg(F.min_by(F.when(F.col("passed"), F.col("id")), F.when(F.col("passed"), F.col("rung"))).alias("winner"))


def starts_by_suffix(series: DataFrame, key: list[str]) -> DataFrame:
    """Earliest start and number of series per key and last letter of the code."""
    return series.groupBy(*key, F.right("code", F.lit(1)).alias("suffix")).agg(F.min("first_date").alias("earliest"), F.count("*").alias("n_series"))
