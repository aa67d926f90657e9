"""The helpers as grouped Spark operations: one task a series or basket, or a block of a long series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbmark.core.windows import KEY
from ebbmark.functions import blocked, helpers


def past_rank(obs: DataFrame, window: int | None, min_periods: int, key: tuple[str, ...] = KEY, size: int = blocked.ROWS) -> DataFrame:
    """Non-null rows of obs(key, date, value) with ``rank`` in all their past or in ``window`` rows of it.

    Series of more than ``size`` rows are ranked in blocks, over many tasks.
    """
    rows = obs.filter("value is not null").select(*key, "date", "value")
    if window is None:
        return blocked.past_rank(rows, key, min_periods, size)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pdf.assign(rank=helpers.rolling_rank(pdf["value"].to_numpy(float), window, min_periods))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        rank = helpers.rolling_rank(pdf["value"].to_numpy(float), window, 1)
        return pdf.assign(rank=np.where(pdf["at"] + 1 >= min_periods, rank, np.nan))[~pdf["halo"]][[*key, "date", "value", "rank"]]

    shape = f"{_ddl(rows)}, rank double"
    short, long, _ = blocked.by_length(rows, key, size)
    out = short.groupBy(*key).applyInPandas(run, shape)
    if long is not None:
        halo = blocked.with_halo(blocked.indexed(long, key, size=size), window - 1, size)
        out = out.unionByName(halo.groupBy(*key, "blk").applyInPandas(inside, shape))
    return out.withColumn("rank", F.when(~F.isnan("rank"), F.col("rank")))


def expanding_quantiles(obs: DataFrame, probs: list[float], min_periods: int, key: tuple[str, ...] = KEY, size: int = blocked.ROWS) -> DataFrame:
    """obs(key, date, value) with ``quantiles`` (array, null before min_periods)."""
    return blocked.expanding_quantiles(obs, probs, min_periods, key, size)


def first_component(returns: DataFrame, series: list[str], window: int) -> DataFrame:
    """(entity_id, date, value) from returns(entity_id, series_id, date, value), one task per entity."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns="series_id", values="value").reindex(columns=series).sort_index()
        score = helpers.rolling_pc1(wide.to_numpy(float), window)
        return pd.DataFrame({"entity_id": pdf["entity_id"].iloc[0], "date": wide.index, "value": score})

    rows = returns.select("entity_id", "series_id", "date", "value")
    out = rows.groupBy("entity_id").applyInPandas(run, "entity_id string, date date, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
