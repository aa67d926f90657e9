"""Positioning history: derive, guard, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbmark.core.tables import small
from ebbmark.core.windows import ratio

RELEASE_LAG_DAYS = 3
MEASURES = ("open_interest_all", "noncomm_positions_long_all", "noncomm_positions_short_all", "traders_noncomm_long_all", "traders_noncomm_short_all")


def typed(raw: DataFrame, *others: str) -> DataFrame:
    """Text columns to a date and doubles; what cannot be read is null. ``others`` are kept as they are."""
    number = lambda c: F.expr(f"try_cast({c} as double)").alias(c)
    return raw.select(
        F.expr("try_cast(substr(report_date_as_yyyy_mm_dd, 1, 10) as date)").alias("date"),
        F.col("cftc_contract_market_code").alias("code"),
        F.col("market_and_exchange_names").alias("name"),
        *map(number, MEASURES),
        *others,
    )


def mismatched_contracts(rows: DataFrame, contracts: DataFrame) -> DataFrame:
    """Identity guard: codes of which no row's name holds the expected text. They are quarantined."""
    named = rows.join(F.broadcast(contracts.select("code", "expect_name_contains")), "code")
    seen = F.coalesce(F.upper("name").contains(F.upper("expect_name_contains")), F.lit(False))
    return named.groupBy("code").agg(F.bool_or(seen).alias("ok")).filter("not ok").select("code")


def last_dates(store: DataFrame) -> DataFrame:
    return store.groupBy("code").agg(F.max("date").alias("last_date"))


def newer(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows dated strictly after the last stored date of their contract; stored(code, last_date) is one row a contract."""
    return rows.join(small(stored), "code", "left").filter("last_date is null or date > last_date").drop("last_date")


def derived(rows: DataFrame, contracts: DataFrame, lag_days: int = RELEASE_LAG_DAYS) -> DataFrame:
    """The store's columns: net, share of open interest (null at zero), traders, knowable-from date."""
    net = F.col("noncomm_positions_long_all") - F.col("noncomm_positions_short_all")
    return (
        rows.filter("date is not null")
        .join(F.broadcast(contracts.select("code", "alias")), "code")
        .select(
            "date",
            F.date_add("date", lag_days).alias("knowable_from"),
            "code",
            "alias",
            net.alias("net"),
            ratio(net, F.col("open_interest_all")).alias("net_pct_oi"),
            *MEASURES[:3],
            (F.col("traders_noncomm_long_all") + F.col("traders_noncomm_short_all")).alias("traders_noncomm"),
        )
    )


def upserted(store: DataFrame, fresh: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per (code, date); a fresh row wins over a stored one, a later one (by ``seq``) over an earlier.

    Hashed on (code, date) once; the sort of that window is over the rows of one key alone.
    """
    none = F.lit(0).cast("long")
    old = store.select("*", F.lit(0).alias("__batch"), none.alias("__seq"))
    new = (fresh if seq is None else fresh.drop(seq)).columns
    add = fresh.select(*new, F.lit(1).alias("__batch"), (none if seq is None else F.col(seq).cast("long")).alias("__seq"))
    over = Window.partitionBy("code", "date").orderBy(F.desc("__batch"), F.desc("__seq"))
    both = old.unionByName(add).withColumn("__rn", F.row_number().over(over))
    return both.filter("__rn = 1").drop("__batch", "__seq", "__rn")


def run_summary(store: DataFrame, added: DataFrame, contracts: DataFrame, today) -> DataFrame:
    """Per contract, also empty ones: status, rows, new rows, first and last date, staleness, last value, late."""
    by = store.groupBy("code").agg(
        F.count("*").alias("rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max_by("net_pct_oi", "date").alias("last_value"),
    )
    new = added.groupBy("code").agg(F.count("*").alias("new_rows"))
    out = contracts.select("code", "alias").join(by, "code", "left").join(new, "code", "left")
    stale = F.datediff(F.lit(today), "last_date")
    return out.select(
        "code",
        "alias",
        F.when(F.col("rows").isNull(), "no rows").otherwise("ok").alias("status"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("new_rows", F.lit(0)).alias("new_rows"),
        "first_date",
        "last_date",
        stale.alias("staleness_days"),
        "last_value",
        F.coalesce(stale > 14, F.lit(False)).alias("late"),
    )
