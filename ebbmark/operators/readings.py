"""From ranks to readings: the calendar grid, replica and improved modes, bands and snapshots."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbmark.core.tables import small, table
from ebbmark.core.windows import expanding, held, ratio
from ebbmark.functions import blocked, grouped
from ebbmark.operators.triggers import checked_rules, fired, hinge

#: Published bands: name and lower edge; anything outside is the last band.
BANDS = (("No signal", 0.0, 0.2), ("Mild", 0.2, 0.4), ("Moderate", 0.4, 0.6), ("Strong", 0.6, 0.8))
LAST_BAND = "Extreme"
QUANTILES = (("Mild", 0.70), ("Moderate", 0.85), ("Strong", 0.95), ("Extreme", 0.99))


def input_grid(ranks: DataFrame, rules: DataFrame, inputs: DataFrame) -> DataFrame:
    """(entity_id, side, date, input_id, cluster, rank, hinge, fired) on the union of dates of each side.

    ranks(entity_id, input_id, date, rank) has one window per input. rules and inputs(input_id,
    cluster) are small and broadcast; the grid is dates x inputs of a side, linear in its output.
    """
    rules = checked_rules(rules)
    if inputs.groupBy("input_id").count().filter("count > 1").limit(1).count():
        raise ValueError("input ids must be unique")
    ruled = rules.select("input_id", "side", "rule", "pct").join(inputs, "input_id")
    if not ruled.limit(1).count():
        raise ValueError("no input has a rule")
    dates = ranks.join(F.broadcast(rules.select("input_id", "side")), "input_id").select("entity_id", "side", "date").distinct()
    grid = dates.join(F.broadcast(ruled), "side")
    full = grid.join(ranks.select("entity_id", "input_id", "date", "rank"), ["entity_id", "input_id", "date"], "left")
    rule = (F.col("rank"), F.col("rule"), F.col("pct"))
    return full.select("entity_id", "side", "date", "input_id", "cluster", "rank", hinge(*rule).alias("hinge"), fired(*rule).alias("fired"))


def readings(grid: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(entity_id, side, mode, date, reading, denominator, fired_count, dropped), both modes.

    replica: fired / available. improved: mean hinge per cluster, then a weighted mean over clusters
    that have one; weights(cluster, weight) is small, a missing weight is 1. One group-by by cluster,
    one by date.
    """
    by = grid.groupBy("entity_id", "side", "date", "cluster").agg(
        F.avg("hinge").alias("h"),
        F.count("rank").alias("n"),
        F.count_if("fired").alias("f"),
        F.collect_list(F.when(F.col("rank").isNull(), F.col("input_id"))).alias("gone"),
    )
    if weights is None:
        by = by.withColumn("w", F.lit(1.0))
    else:
        by = by.join(F.broadcast(weights.select("cluster", F.col("weight").alias("w"))), "cluster", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    used = F.when(F.col("h").isNotNull(), F.col("w"))
    one = by.groupBy("entity_id", "side", "date").agg(
        ratio(F.sum(F.col("w") * F.col("h")), F.sum(used)).alias("improved"),
        F.sum("n").alias("denominator"),
        F.sum("f").alias("fired_count"),
        F.array_sort(F.flatten(F.collect_list("gone"))).alias("dropped"),
    )
    one = one.withColumn("replica", F.col("fired_count") / F.nullif("denominator", F.lit(0)))
    modes = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(m).alias("reading")) for m in ("replica", "improved"))))
    return one.withColumn("m", modes).select("entity_id", "side", "m.mode", "date", "m.reading", "denominator", "fired_count", "dropped")


def band(reading: Column) -> Column:
    """Published label; null stays null, anything outside the edges (also below 0) is the last band."""
    out = F.when(reading.isNull(), F.lit(None).cast("string"))
    for name, lo, hi in BANDS:
        out = out.when((reading >= lo) & (reading < hi), name)
    return out.otherwise(LAST_BAND)


def snapshot(reads: DataFrame) -> DataFrame:
    """The latest row of each (entity_id, side, mode), with its band."""
    last = reads.groupBy("entity_id", "side", "mode").agg(F.max_by(F.struct("date", "reading", "denominator", "fired_count", "dropped"), "date").alias("x"))
    return last.select("entity_id", "side", "mode", "x.*").withColumn("band", band(F.col("reading")))


def without_periods(obs: DataFrame, periods: DataFrame) -> DataFrame:
    """Crisis filter: values in years lo..hi become null for the inputs named in periods(series_id, lo, hi)."""
    spans = F.broadcast(periods.groupBy("series_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    hit = F.exists("spans", lambda s: F.year("date").between(s["lo"], s["hi"]))
    return obs.join(spans, "series_id", "left").withColumn("value", F.when(F.coalesce(hit, F.lit(False)), None).otherwise(F.col("value"))).drop("spans")


def trend_gate(signals: DataFrame, gate: DataFrame, window: int = 200) -> DataFrame:
    """Sell signals count only while gate(entity_id, date, value) is below its mean over ``window`` rows."""
    over = Window.partitionBy("entity_id").orderBy("date").rowsBetween(-(window - 1), 0)
    open_ = gate.select("entity_id", "date", (F.col("value") < held(F.avg("value"), "value", over, window)).alias("open"))
    kept = F.when((F.col("side") != "sell") | F.coalesce("open", F.lit(False)), F.col("fired")).otherwise(F.lit(False))
    return signals.join(open_, ["entity_id", "date"], "left").withColumn("fired", F.when(F.col("fired").isNotNull(), kept)).drop("open")


#: Dates and inputs to a side of a task's matrices of products.
DAYS, WIDTH = 512, 256


def correlated(obs: DataFrame, least: float = 0.70, days: int = DAYS, width: int = WIDTH) -> DataFrame:
    """(entity_id, id_a, id_b, corr): pairs of an entity's inputs with correlation >= least, over complete pairs.

    Inputs are cut into groups of ``width`` and dates into blocks of ``days``. A task has one block and two groups,
    and yields for each pair its count, sums, squares and products by matrix products; these add up over blocks. A row
    is sent once for each group of its entity, however many pairs a date has. A pair where either side does not vary
    has no correlation. (entity_id, series_id, date) is unique.
    """
    known = obs.filter("value is not null").select("entity_id", "series_id", "date", "value")
    moments = known.groupBy("entity_id", "series_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("series_id")) - 1
    names = table(moments.withColumn("no", place).withColumn("groups", F.ceil(F.count("*").over(Window.partitionBy("entity_id")) / width).cast("int")), "inputs")
    grp, other = F.floor(F.col("no") / width).cast("int"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    # values are centred and scaled by the whole series, so that sums of products lose no digits
    unit = ((F.col("value") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("v")
    cells = known.join(small(names), ["entity_id", "series_id"]).select("entity_id", F.floor(F.unix_date("date") / days).alias("blk"), "date", "no", unit, grp.alias("grp"), other.alias("other"))
    cells = cells.withColumns({"one": F.least("grp", "other"), "two": F.greatest("grp", "other")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf["one"].iloc[0], pdf["two"].iloc[0]
        wide = pdf.pivot(index="date", columns="no", values="v")
        at = [wide.columns[wide.columns // width == g] for g in (one, two)]
        x, y = (wide[c].to_numpy(float) for c in at)
        mx, my = ((~np.isnan(m)).astype(float) for m in (x, y))
        x, y = np.nan_to_num(x), np.nan_to_num(y)
        sums = {"n": mx.T @ my, "sx": x.T @ my, "sy": mx.T @ y, "sxx": (x * x).T @ my, "syy": mx.T @ (y * y), "sxy": x.T @ y}
        i, j = np.nonzero((at[0].to_numpy()[:, None] < at[1].to_numpy()) & (sums["n"] > 0))
        return pd.DataFrame({"entity_id": pdf["entity_id"].iloc[0], "a": at[0].to_numpy()[i], "b": at[1].to_numpy()[j], **{k: v[i, j] for k, v in sums.items()}})

    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    parts = cells.groupBy("entity_id", "blk", "one", "two").applyInPandas(run, "entity_id string, a int, b int, " + ", ".join(f"{c} double" for c in sums))
    total = parts.groupBy("entity_id", "a", "b").agg(*(F.sum(c).alias(c) for c in sums))
    vary = lambda s, q: F.when(F.col("n") * F.col(q) - F.col(s) * F.col(s) > 1e-12 * F.col("n") * F.col(q), F.col("n") * F.col(q) - F.col(s) * F.col(s))
    corr = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vary("sx", "sxx") * vary("sy", "syy"))
    high = total.select("entity_id", "a", "b", corr.alias("corr")).filter(F.col("corr") >= least)
    named = lambda no, name: small(names.select("entity_id", F.col("no").alias(no), F.col("series_id").alias(name)))
    return high.join(named("a", "id_a"), ["entity_id", "a"]).join(named("b", "id_b"), ["entity_id", "b"]).select("entity_id", "id_a", "id_b", "corr")


def correlated_clusters(inputs: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, series_id, cluster): inputs that a chain of correlated() pairs joins share the least series_id.

    Labels pass along the pairs until none changes; the rounds are at most an entity's number of inputs.
    """
    both = table(edges.select("entity_id", F.col("id_a").alias("series_id"), F.col("id_b").alias("other")).unionByName(edges.select("entity_id", F.col("id_b").alias("series_id"), F.col("id_a").alias("other"))), "edges")
    labels = table(inputs.select("entity_id", "series_id", F.col("series_id").alias("cluster")), "labels")
    while True:
        met = both.join(labels.select("entity_id", F.col("series_id").alias("other"), F.col("cluster").alias("theirs")), ["entity_id", "other"])
        least = met.groupBy("entity_id", "series_id").agg(F.min("theirs").alias("theirs"))
        moved = labels.join(least, ["entity_id", "series_id"], "left").select("entity_id", "series_id", F.least("cluster", "theirs").alias("cluster"), (F.col("theirs") < F.col("cluster")).alias("moved"))
        moved = table(moved, "labels")
        labels = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return labels


def calibrated(reads: DataFrame) -> DataFrame:
    """(entity_id, side, mode, band, threshold): exact interpolated quantiles of the reading."""
    q = reads.groupBy("entity_id", "side", "mode").agg(F.percentile("reading", F.array(*(F.lit(p) for _, p in QUANTILES))).alias("q"))
    return q.select("entity_id", "side", "mode", F.explode(F.array(*(F.struct(F.lit(n).alias("band"), F.get("q", F.lit(i)).alias("threshold")) for i, (n, _) in enumerate(QUANTILES)))).alias("x")).select("entity_id", "side", "mode", "x.*")


def walk_forward(reads: DataFrame, min_periods: int = 756, long_series: bool = True, size: int = blocked.ROWS) -> DataFrame:
    """reads with ``thresholds`` (array by QUANTILES) from each row's own past."""
    key = ("entity_id", "side", "mode")
    if long_series:
        rows = reads.select(*key, "date", F.col("reading").alias("value"))
        return grouped.expanding_quantiles(rows, [p for _, p in QUANTILES], min_periods, key, size).select(*key, "date", F.col("quantiles").alias("thresholds"))
    over = expanding(*key)
    q = held(F.percentile("reading", F.array(*(F.lit(p) for _, p in QUANTILES))), "reading", over, min_periods)
    return reads.select(*key, "date", q.alias("thresholds"))
