"""Long series over many tasks: row numbers, scans, ranks and order statistics in blocks, all exact.

Every function splits its series by counted length. Series of at most ``size`` rows are one group each, as in
``grouped``; longer ones are cut into blocks of ``size`` rows by their row number, which Spark's range partitioning
yields without a window over a whole series. What a block must know of the others is a summary of it (a total, a
last value, counts by bins of values); summaries of one series are few and are scanned by windows over blocks.

Values of a long series fall into bins, given by approximate quantiles: open intervals between neighbouring ones,
and each quantile by itself. So a value that many rows share has a bin of its own, whose members are all equal and
need no comparing, and every other bin holds some ``size`` rows. The bins of all long series together are about
as many as their blocks, which bounds what the driver reads and tasks receive.

(key, date) is unique and keys are not null; value may be null where a function says so.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbmark.core.tables import small, table
from ebbmark.functions import helpers

ROWS = 1 << 18


def by_length(rows: DataFrame, key: tuple[str, ...], size: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows of short series, rows of long ones or None, longest length)."""
    lengths = table(rows.groupBy(*key).agg(F.count("*").alias("__n")).filter(F.col("__n") > size), "long")
    most = lengths.agg(F.max("__n")).first()[0]
    if most is None:
        return rows, None, 0
    long = small(lengths.drop("__n"))
    return rows.join(long, list(key), "left_anti"), rows.join(long, list(key), "left_semi"), most


def indexed(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...] = ("date",), size: int = ROWS) -> DataFrame:
    """rows, as a table, with ``at``: the row's number in its series from 0 on; no task holds a whole long series."""
    rows = table(rows, "rows")
    parts = max(1, math.ceil(rows.count() / size))
    cut = table(rows.repartitionByRange(parts, *key, *order).withColumn("__part", F.spark_partition_id()), "cut")
    spans = cut.groupBy(*key, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = table(spans.select(*key, "__part", before.alias("__before")), "spans")
    place = F.row_number().over(Window.partitionBy(*key, "__part").orderBy(*order)) - 1
    return table(cut.withColumn("__in", place).join(small(spans), [*key, "__part"]).withColumn("at", F.col("__before") + F.col("__in")).drop("__part", "__in", "__before"), "indexed")


def block_of(size: int) -> Column:
    return F.floor(F.col("at") / size).cast("long")


def _upto(*key: str) -> tuple:
    """Windows over the rows of a block up to the present one, and over the blocks before."""
    own = Window.partitionBy(*key, "blk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*key).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    return own, earlier


def running_sum(numbered: DataFrame, key: tuple[str, ...], values: list[str], size: int = ROWS) -> DataFrame:
    """indexed() rows with run_<value>: the total up to the row, as a scan of blocks and of block totals."""
    own, earlier = _upto(*key)
    cut = numbered.withColumn("blk", block_of(size))
    totals = cut.groupBy(*key, "blk").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    totals = table(totals.select(*key, "blk", *(F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0.0)).alias(f"__{v}") for v in values)), "totals")
    runs = cut.withColumns({f"run_{v}": F.coalesce(F.sum(v).over(own), F.lit(0.0)) for v in values}).join(small(totals), [*key, "blk"])
    return runs.withColumns({f"run_{v}": F.col(f"run_{v}") + F.col(f"__{v}") for v in values}).drop("blk", *(f"__{v}" for v in values))


def last_known(numbered: DataFrame, key: tuple[str, ...], known: str, size: int = ROWS) -> DataFrame:
    """indexed() rows with ``known`` replaced by its last non-null value up to the row: inside the block, else from the blocks before."""
    own, earlier = _upto(*key)
    cut = numbered.withColumn("blk", block_of(size))
    lasts = cut.groupBy(*key, "blk").agg(F.max_by(known, F.when(F.col(known).isNotNull(), F.col("at"))).alias("__last"))
    lasts = table(lasts.select(*key, "blk", F.last("__last", ignorenulls=True).over(earlier).alias("__last")), "lasts")
    filled = cut.withColumn(known, F.last(known, ignorenulls=True).over(own)).join(small(lasts), [*key, "blk"])
    return filled.withColumn(known, F.coalesce(known, "__last")).drop("blk", "__last")


def with_halo(numbered: DataFrame, rows: int, size: int = ROWS) -> DataFrame:
    """indexed() rows with ``blk``, those within ``rows`` of a block's end also in the next block, as ``halo``."""
    size = max(size, rows)
    own = block_of(size)
    also = F.when(F.col("at") % size >= size - rows, F.struct((own + 1).alias("blk"), F.lit(True).alias("halo")))
    both = F.array_compact(F.array(F.struct(own.alias("blk"), F.lit(False).alias("halo")), also))
    return numbered.withColumn("__x", F.explode(both)).select(*numbered.columns, "__x.blk", "__x.halo")


def _bounds(numbered: DataFrame, key: tuple[str, ...], longest: int, size: int) -> dict[tuple, np.ndarray]:
    """Each long series' distinct approximate quantiles, about one for ``size`` rows of the longest."""
    bins = max(2, math.ceil(2 * longest / size))
    probs = [i / bins for i in range(1, bins)]
    got = numbered.filter("value is not null").groupBy(*key).agg(F.percentile_approx("value", probs, 20 * bins).alias("b")).collect()
    return {tuple(r[k] for k in key): np.unique(np.array(r["b"], float)) for r in got}


def _bins(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """2 i between quantiles i - 1 and i, 2 i + 1 at quantile i."""
    at = np.searchsorted(bounds, values, "left")
    return 2 * at + (bounds[np.minimum(at, len(bounds) - 1)] == values)


def _before(counts: DataFrame, key: tuple[str, ...], top: int) -> DataFrame:
    """(key, blk, bin, upto): values in blocks before blk and bins up to bin, for every bin 0 to top."""
    grid = counts.select(*key, "blk").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(top))))
    full = grid.join(counts, [*key, "blk", "bin"], "left")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy(*key, "bin").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lower = F.sum("e").over(Window.partitionBy(*key, "blk").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return full.select(*key, "blk", "bin", earlier.alias("e")).select(*key, "blk", "bin", lower.alias("upto"))


def _ddl(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*names).schema)


def past_rank(rows: DataFrame, key: tuple[str, ...], min_periods: int, size: int = ROWS) -> DataFrame:
    """rows(key, date, value not null) with ``rank``: the share of the values so far that are <= the row's own.

    That count is the sum of three: earlier blocks' values in lower bins (by scanned counts), the block's earlier
    values in lower bins, and the earlier values of the same bin, compared in one task for each bin.
    """
    rows = rows.select(*key, "date", "value")
    shape = _ddl(rows, *key, "date", "value")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pdf.assign(rank=helpers.causal_rank(pdf["value"].to_numpy(float), min_periods))

    short, long, longest = by_length(rows, key, size)
    out = short.groupBy(*key).applyInPandas(whole, f"{shape}, rank double")
    if long is None:
        return out.withColumn("rank", F.when(~F.isnan("rank"), F.col("rank")))
    numbered = indexed(long, key, size=size).withColumn("blk", block_of(size))
    bounds = _bounds(numbered, key, longest, size)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        b = _bins(pdf["value"].to_numpy(float), bounds[tuple(pdf[k].iloc[0] for k in key)])
        return pdf.assign(bin=b, c=helpers.count_at_most(b, np.where(b % 2, b, b - 1)))

    def same(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        v = pdf["value"].to_numpy(float)
        return pdf.assign(c=pdf["c"] + helpers.count_at_most(v, v))

    full = f"{shape}, at long, blk long, bin int, c long"
    cut = table(numbered.groupBy(*key, "blk").applyInPandas(inside, full), "binned")
    upto = _before(cut.groupBy(*key, "blk", "bin").agg(F.count("*").alias("n")), key, 2 * max(map(len, bounds.values())))
    upto = table(upto, "upto")
    point = cut.filter("bin % 2 = 1")
    gap = cut.filter("bin % 2 = 0").groupBy(*key, "bin").applyInPandas(same, full)
    # the earlier blocks' values of the bins below, for a single value's bin also those of its own
    lower = point.unionByName(gap).withColumn("__b", F.when(F.col("bin") % 2 == 1, F.col("bin")).otherwise(F.col("bin") - 1))
    met = lower.join(small(upto.withColumnRenamed("bin", "__b")), [*key, "blk", "__b"], "left")
    share = (F.coalesce("upto", F.lit(0)) + F.col("c")) / (F.col("at") + 1)
    done = met.select(*key, "date", "value", F.when(F.col("at") + 1 >= min_periods, share).alias("rank"))
    return out.withColumn("rank", F.when(~F.isnan("rank"), F.col("rank"))).unionByName(done)


def expanding_quantiles(rows: DataFrame, probs: list[float], min_periods: int, key: tuple[str, ...], size: int = ROWS) -> DataFrame:
    """rows(key, date, value) with ``quantiles`` of the values so far (array, null before ``min_periods`` of them).

    A block finds by counts in which bin each row's order statistics are, and which of the bin's values so far
    they are. The bin's values then meet the block's questions, in one task for each bin and block, where a
    wavelet matrix answers all of them at once.
    """
    rows = rows.select(*key, "date", "value")
    shape = _ddl(rows, *key, "date", "value")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        q = helpers.expanding_quantiles(pdf["value"].to_numpy(float), probs, min_periods)
        return pdf.assign(quantiles=[None if np.isnan(r).any() else r for r in q])

    short, long, longest = by_length(rows, key, size)
    out = short.groupBy(*key).applyInPandas(whole, f"{shape}, quantiles array<double>")
    if long is None:
        return out
    numbered = table(indexed(long, key, size=size).withColumn("blk", block_of(size)), "numbered")
    bounds = _bounds(numbered, key, longest, size)
    if not bounds:  # no values at all
        return out.unionByName(numbered.select(*key, "date", "value", F.lit(None).cast("array<double>").alias("quantiles")))
    top = 2 * max(map(len, bounds.values()))
    keyed = _ddl(rows, *key)
    none = np.array([0.0])

    def binned(pdf: pd.DataFrame) -> pd.DataFrame:
        b = _bins(pdf["value"].to_numpy(float), bounds.get(tuple(pdf[k].iloc[0] for k in key), none))
        return pdf.assign(bin=np.where(pdf["value"].isna(), -1, b))

    cut = table(numbered.groupBy(*key, "blk").applyInPandas(binned, f"{shape}, at long, blk long, bin int"), "binned")
    counts = cut.groupBy(*key, "blk", "bin").agg(F.count("*").alias("n"))  # bin -1 keeps blocks without values
    upto = table(_before(counts, key, top), "upto").groupBy(*key, "blk").agg(F.array_sort(F.collect_list(F.struct("bin", "upto"))).alias("u")).select(*key, "blk", F.col("u.upto").alias("upto"))
    upto = table(upto, "upto")

    def asked(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        names = tuple(pdf[k].iloc[0] for k in key)
        edge, bins, at = bounds.get(names, none), pdf["bin"].to_numpy(), pdf["at"].to_numpy()
        seen, parts = np.diff(np.asarray(before["upto"].iloc[0], np.int64), prepend=0), []
        for a in range(0, len(pdf), 4096):
            b = bins[a : a + 4096]
            one = np.zeros((len(b), top + 1), np.int64)
            one[np.flatnonzero(b >= 0), b[b >= 0]] = 1
            held = np.cumsum(one, axis=0) + seen
            seen = held[-1]
            lower = np.cumsum(held, axis=1)
            n = lower[:, -1]
            ok = np.flatnonzero(n >= max(min_periods, 1))
            for j, p in enumerate(probs):
                spot = p * (n[ok] - 1)
                for side, k in enumerate((np.floor(spot).astype(np.int64), np.minimum(np.floor(spot).astype(np.int64) + 1, n[ok] - 1))):
                    bin_ = (lower[ok] <= k[:, None]).sum(axis=1)
                    under = np.where(bin_ > 0, lower[ok, np.maximum(bin_ - 1, 0)], 0)
                    single = bin_ % 2 == 1
                    parts.append(pd.DataFrame({"at": at[a + ok], "j": 2 * j + side, "part": spot - np.floor(spot), "bin": bin_, "t": held[ok, bin_], "k": k - under, "found": np.where(single, edge[np.minimum(bin_ // 2, len(edge) - 1)], np.nan)}))
        got = pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("at", "j", "part", "bin", "t", "k", "found")})
        return got.assign(**dict(zip(key, names)), blk=pdf["blk"].iloc[0])

    wanted = "blk long, at long, j int, part double, bin int, t long, k long, found double"
    ask = table(cut.groupBy(*key, "blk").cogroup(upto.groupBy(*key, "blk")).applyInPandas(asked, f"{keyed}, {wanted}"), "asked")

    def answered(ask_: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        if not len(ask_):
            return ask_
        v = values.sort_values("at")["value"].to_numpy(float)
        return ask_.assign(found=helpers.kth_smallest(v, ask_["t"].to_numpy(), ask_["k"].to_numpy()))

    open_ = ask.filter("bin % 2 = 0")
    pairs = small(table(open_.select(*key, "bin", F.col("blk").alias("for")).distinct(), "pairs"))
    given = cut.filter("bin >= 0 and bin % 2 = 0").join(pairs, [*key, "bin"]).filter("blk <= for").select(*key, "bin", "at", "value", F.col("for").alias("blk"))
    told = open_.groupBy(*key, "bin", "blk").cogroup(given.groupBy(*key, "bin", "blk")).applyInPandas(answered, f"{keyed}, {wanted}")
    every = ask.filter("bin % 2 = 1").unionByName(told).groupBy(*key, "at").agg(
        *(F.max(F.when(F.col("j") == i, F.col("found"))).alias(f"f{i}") for i in range(2 * len(probs))), *(F.max(F.when(F.col("j") == 2 * i, F.col("part"))).alias(f"p{i}") for i in range(len(probs)))
    )
    q = every.select(*key, "at", F.array(*(F.col(f"f{2 * i}") + (F.col(f"f{2 * i + 1}") - F.col(f"f{2 * i}")) * F.col(f"p{i}") for i in range(len(probs)))).alias("quantiles"))
    return out.unionByName(numbered.join(q, [*key, "at"], "left").select(*key, "date", "value", "quantiles"))
