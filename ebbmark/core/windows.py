"""Windows over long tables (entity_id, series_id, date, value); null is missing and NaN does not occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ("entity_id", "series_id")
#: Rows of a month and of a year by frequency.
PER_MONTH = {"daily": 21, "weekly": 4.348}
PER_YEAR = {"daily": 252, "weekly": 52}


def ordered(*key: str) -> WindowSpec:
    return Window.partitionBy(*(key or KEY)).orderBy("date")


def expanding(*key: str) -> WindowSpec:
    return ordered(*key).rowsBetween(Window.unboundedPreceding, 0)


def rolling(n: int, *key: str) -> WindowSpec:
    return ordered(*key).rowsBetween(-(n - 1), 0)


def held(agg: Column, value: Column | str, window: WindowSpec, least: int) -> Column:
    """agg over window where it holds at least ``least`` values, else null."""
    return F.when(F.count(value).over(window) >= least, agg.over(window))


def month_rows(months: float, freq: str = "daily") -> int:
    return max(round(months * PER_MONTH[freq]), 1)


def year_rows(years: float, freq: str = "daily") -> int:
    return round(years * PER_YEAR[freq])


def without_nan(df: DataFrame, *names: str) -> DataFrame:
    """NaN becomes null, once, at the reader."""
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))
