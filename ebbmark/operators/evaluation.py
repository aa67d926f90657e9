"""Judging signals: forward returns, lift over the base rate, tests that respect overlap, bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbmark.core.tables import small, table
from ebbmark.core.windows import KEY, ordered, ratio
from ebbmark.functions import blocked
from ebbmark.operators.readings import QUANTILES, calibrated

SIGNAL_KEY = ("entity_id", "side", "horizon")


def forward_returns(prices: DataFrame, horizons: list[int]) -> DataFrame:
    """(entity_id, series_id, date, horizon, fwd): all horizons from one ordered pass over the prices."""
    ahead = F.array(*(F.struct(F.lit(h).alias("horizon"), (ratio(F.lead("value", h).over(ordered()), F.col("value")) - 1).alias("fwd")) for h in horizons))
    return prices.select(*KEY, "date", ahead.alias("xs")).select(*KEY, "date", F.explode("xs").alias("x")).select(*KEY, "date", "x.*")


def paired(forward: DataFrame, signals: DataFrame) -> DataFrame:
    """Complete rows of forward(entity_id, date, horizon, fwd) and signals(entity_id, side, date, sig), with hit.

    The outcome is a negative return for sell and a positive one for buy.
    """
    rows = forward.select("entity_id", "date", "horizon", "fwd").join(signals, ["entity_id", "date"]).filter("fwd is not null and sig is not null")
    return rows.withColumn("hit", F.when(F.col("side") == "sell", F.col("fwd") < 0).otherwise(F.col("fwd") > 0).cast("double"))


def _numbered(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame | None]:
    """rows with ``at``, their number by date within the key: of short keys by a window, of long ones as blocked.indexed()."""
    short, long, _ = blocked.by_length(rows, SIGNAL_KEY, size)
    place = F.row_number().over(Window.partitionBy(*SIGNAL_KEY).orderBy("date")) - 1
    return short.withColumn("at", place.cast("long")), None if long is None else blocked.indexed(long, SIGNAL_KEY, size=size).withColumn("at", F.col("at").cast("long"))


def _moving_totals(rows: DataFrame, horizons: list[int], size: int) -> DataFrame:
    """rows(key, date, g) with at, c (the running total of g) and before (c as many rows earlier as the lags plus one).

    A long key's running total is a scan of blocks and block totals; the earlier total is at hand in the block,
    as each block also has the last rows of the one before.
    """
    key, far = list(SIGNAL_KEY), max([2, *horizons])
    short, long = _numbered(rows, size)

    def earlier(df: DataFrame, *by: str) -> DataFrame:
        ordered_ = Window.partitionBy(*key, *by).orderBy("at")
        before = F.lit(None).cast("double")
        for h in horizons:
            before = F.when(F.col("horizon") == h, F.lag("c", max(h, 2)).over(ordered_)).otherwise(before)
        return df.withColumn("before", before)

    upto = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    out = earlier(short.withColumn("c", F.sum("g").over(upto)))
    if long is None:
        return out
    runs = table(blocked.running_sum(long, SIGNAL_KEY, ["g"], size).withColumnRenamed("run_g", "c"), "runs")
    return out.unionByName(earlier(blocked.with_halo(runs, far, size), "blk").filter("not halo").drop("blk", "halo"))


def mean_difference(rows: DataFrame, size: int = blocked.ROWS) -> DataFrame:
    """(key, difference, se, t_stat, n, n_signal, n_effective, lags): dummy regression, Newey-West errors.

    rows(key, date, fwd, sig). For a constant and a dummy everything is sums: with u the residual, the
    dummy's variance needs only the Bartlett-weighted products of g = u * (sig / n1 - (1 - sig) / n0).
    Bartlett weights over L lags are those of a box of L + 1 rows with itself, so their sum is the sum of
    squares of g's moving totals over L + 1 rows, also those that reach over an end, by L + 1. Moving totals
    are differences of one running total: a single ordered pass, whatever the number of lags.
    """
    key = list(SIGNAL_KEY)
    means = table(
        rows.groupBy(*key).agg(
            F.count("*").alias("n"),
            F.count_if("sig").alias("n1"),
            F.avg(F.when(F.col("sig"), F.col("fwd"))).alias("m1"),
            F.avg(F.when(~F.col("sig"), F.col("fwd"))).alias("m0"),
        ),
        "means",
    )
    horizons = sorted(r[0] for r in means.select("horizon").distinct().collect())
    enough = means.filter("n >= 30 and n1 >= 5 and n - n1 >= 5")
    score = F.when(F.col("sig"), (F.col("fwd") - F.col("m1")) / F.col("n1")).otherwise(-(F.col("fwd") - F.col("m0")) / (F.col("n") - F.col("n1")))
    lags = F.greatest(F.col("horizon") - 1, F.lit(1))
    summed = _moving_totals(rows.join(small(enough), key).select(*key, "date", "n", score.alias("g")), horizons, size)
    moving = F.col("c") - F.coalesce("before", F.lit(0.0))
    # residuals add up to zero, so what is left from a row on is minus the total before it
    rest = F.when((F.col("at") > 0) & (F.col("at") >= F.col("n") - lags), F.col("c") - F.col("g")).otherwise(0.0)
    squares = summed.select(*key, (moving * moving + rest * rest).alias("sq"))
    variance = squares.groupBy(*key).agg((F.sum("sq") / (F.first(lags) + 1)).alias("v"))
    se = F.sqrt(F.greatest(F.col("v"), F.lit(0.0)))
    tested = F.col("v").isNotNull()
    diff = F.when(tested, F.col("m1") - F.col("m0"))
    return means.join(variance, key, "left").select(
        *key,
        diff.alias("difference"),
        se.alias("se"),
        F.when(se > 0, diff / se).alias("t_stat"),
        F.col("n"),
        F.col("n1").alias("n_signal"),
        F.when(tested, F.col("n") / F.greatest("horizon", F.lit(1))).alias("n_effective"),
        F.when(tested, lags).alias("lags"),
    )


def non_overlapping(rows: DataFrame, size: int = blocked.ROWS) -> DataFrame:
    """(key, difference, dispersion, n_blocks, offsets_used): every horizon-th complete row, over all offsets."""
    key = list(SIGNAL_KEY)
    short, long = _numbered(rows.select(*key, "date", "fwd", "sig"), size)
    cut = (short if long is None else short.unionByName(long)).withColumn("offset", F.pmod("at", F.col("horizon")))
    each = cut.groupBy(*key, "offset").agg(
        F.count("*").alias("n"),
        F.count_if("sig").alias("n1"),
        (F.avg(F.when(F.col("sig"), F.col("fwd"))) - F.avg(F.when(~F.col("sig"), F.col("fwd")))).alias("d"),
    )
    ok = (F.col("n1") >= 3) & (F.col("n") - F.col("n1") >= 3)
    total = each.groupBy(*key).agg(
        F.sum("n").alias("rows"),
        F.avg(F.when(ok, F.col("d"))).alias("difference"),
        F.stddev_pop(F.when(ok, F.col("d"))).alias("dispersion"),
        F.avg(F.when(ok, F.col("n"))).alias("n_blocks"),
        F.count_if(ok).alias("offsets_used"),
    )
    enough = F.col("rows") >= 4 * F.col("horizon")
    zero = lambda c: F.coalesce(F.when(enough, F.col(c).cast("double")), F.lit(0.0)).alias(c)
    return total.select(*key, *(F.when(enough, F.col(c)).alias(c) for c in ("difference", "dispersion")), zero("n_blocks"), zero("offsets_used"))


def evaluate(rows: DataFrame) -> DataFrame:
    """One row per (entity_id, side, horizon) of paired(): rates, lift, returns and both tests."""
    key = list(SIGNAL_KEY)
    on = F.col("sig")
    rates = rows.groupBy(*key).agg(
        F.avg("hit").alias("base_rate"),
        F.avg(F.when(on, F.col("hit"))).alias("conditional_rate"),
        F.avg("fwd").alias("mean_return_all"),
        F.avg(F.when(on, F.col("fwd"))).alias("mean_return_signal"),
    )
    test = mean_difference(rows).select(*key, F.col("difference").alias("return_difference"), "t_stat", "n", "n_signal", "n_effective")
    apart = non_overlapping(rows).select(*key, F.col("difference").alias("non_overlapping_difference"))
    return rates.join(test, key).join(apart, key).withColumns({"lift": F.col("conditional_rate") - F.col("base_rate"), "lift_ratio": ratio(F.col("conditional_rate"), F.col("base_rate"))})


def evaluate_by_band(rows: DataFrame) -> DataFrame:
    """Lift by band: rows of paired() with ``band``. Totals join back by key, one row each."""
    key = list(SIGNAL_KEY)
    rows = rows.filter("band is not null")
    totals = rows.groupBy(*key).agg(F.count("*").alias("total"), F.avg("hit").alias("base_rate"), F.avg("fwd").alias("mean_return_all"))
    each = rows.groupBy(*key, "band").agg(F.count("*").alias("n"), F.avg("hit").alias("conditional_rate"), F.avg("fwd").alias("mean_return"))
    n_eff = F.col("n") / F.greatest("horizon", F.lit(1))
    return each.join(totals, key).select(
        *key,
        "band",
        "n",
        n_eff.alias("n_effective"),
        (F.col("n") / F.col("total")).alias("share_of_time"),
        "base_rate",
        "conditional_rate",
        (F.col("conditional_rate") - F.col("base_rate")).alias("lift"),
        "mean_return",
        "mean_return_all",
        (F.col("mean_return") - F.col("mean_return_all")).alias("return_difference"),
        (n_eff < 10).alias("thin"),
    )


def drawn_blocks(sizes: DataFrame, key: list[str], n_boot: int, mean_block: Column, seed: int = 0) -> DataFrame:
    """(key, rep, start, length): the stationary bootstrap's blocks for sizes(key, n), n rows in all for each replicate.

    Block j of a replicate begins anywhere alike and is 1 + geometric long, wrapping round the end; both come from
    the md5 of (seed, key, replicate, j), so any engine draws the same. Twice as many blocks as are expected, and
    20 more, are drawn; should they not do, the last one is as long as it must be.
    """
    n, b = F.col("n"), F.col("b")
    reps = sizes.select(*key, "n", mean_block.cast("double").alias("b")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    most = F.ceil(2 * n / b).cast("int") + 20
    each = reps.withColumn("last", most - 1).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("last"))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key), F.col("rep").cast("string"), F.col("j").cast("string")).cast("binary"))
    each = each.withColumn("h", digest)
    whole = lambda at: F.conv(F.substring("h", at, 8), 16, 10).cast("long")
    start = F.floor(whole(1) * n / F.lit(2.0**32)).cast("long")
    length = F.when(b > 1, 1 + F.floor(F.ln((whole(9) + 0.5) / F.lit(2.0**32)) / F.ln(1 - 1 / b))).otherwise(1).cast("long")
    before = F.coalesce(F.sum("length").over(Window.partitionBy(*key, "rep").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = each.withColumn("start", start).withColumn("length", F.when(F.col("j") == F.col("last"), n).otherwise(F.least(length, n))).withColumn("before", before)
    return laid.filter(F.col("before") < n).select(*key, "n", "rep", "start", F.least("length", n - F.col("before")).alias("length"))


def bootstrap_lift(rows: DataFrame, n_boot: int = 500, seed: int = 0, alpha: float = 0.05, mean_block: int | None = None, size: int = blocked.ROWS) -> DataFrame:
    """(key, lift_lo, lift_hi): stationary-bootstrap interval of the lift.

    No replicate copies its series: it is its blocks, and a block's counts are differences of running totals at
    its ends, which a join looks up. Replicates with fewer than 5 rows on either side do not count; fewer than 20
    usable ones give null.
    """
    key = list(SIGNAL_KEY)
    short, long = _numbered(rows.select(*key, "date", F.col("hit").cast("double").alias("hit"), F.col("sig").cast("double").alias("on"), (F.col("hit") * F.col("sig").cast("double")).alias("both")), size)
    upto = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counts = ["hit", "on", "both"]
    runs = short.withColumns({f"run_{c}": F.sum(c).over(upto) for c in counts})
    if long is not None:
        runs = runs.unionByName(blocked.running_sum(long, SIGNAL_KEY, counts, size))
    # totals of the rows before a place; place n has those of all rows
    totals = table(runs.select(*key, (F.col("at") + 1).alias("at"), F.struct(*(F.col(f"run_{c}").alias(c) for c in counts)).alias("t")), "totals")
    sizes = table(totals.groupBy(*key).agg(F.max("at").alias("n"), F.max_by("t", "at").alias("all")), "sizes")
    drawn = drawn_blocks(sizes, key, n_boot, F.greatest("horizon", F.lit(2)) if mean_block is None else F.lit(mean_block), seed)
    end = F.col("start") + F.col("length")
    # a block that wraps is all of the series less what lies between its ends
    ends = drawn.select(*key, "n", "rep", F.explode(F.array(F.struct(F.lit(-1.0).alias("by"), F.col("start").alias("at"), F.lit(False).alias("wraps")), F.struct(F.lit(1.0).alias("by"), F.when(end > F.col("n"), end - F.col("n")).otherwise(end).alias("at"), (end > F.col("n")).alias("wraps")))).alias("e")).select(*key, "n", "rep", "e.*")
    met = ends.join(totals, [*key, "at"], "left").join(small(sizes.drop("n")), key)
    part = lambda c: F.sum(F.col("by") * F.coalesce(F.col(f"t.{c}"), F.lit(0.0)) + F.when(F.col("wraps"), F.col(f"all.{c}")).otherwise(0.0)).alias(c)
    each = met.groupBy(*key, "n", "rep").agg(*(part(c) for c in counts)).filter("on >= 5 and n - on >= 5")
    lift = F.col("both") / F.col("on") - F.col("hit") / F.col("n")
    q = each.groupBy(*key).agg(F.count("*").alias("kept"), F.percentile(lift, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    q = sizes.select(*key).join(q, key, "left")
    return q.select(*key, *(F.when(F.col("kept") >= 20, F.get("q", F.lit(i))).alias(c) for i, c in enumerate(("lift_lo", "lift_hi"))))


def bootstrap_bands(reads: DataFrame, n_boot: int = 500, block: int = 21, seed: int = 0, alpha: float = 0.05, chunk: int = 100, size: int = blocked.ROWS) -> DataFrame:
    """(entity_id, side, mode, band, quantile, threshold, lo, hi, width); keys under 100 readings give no rows.

    Replicates are drawn_blocks(). A task takes ``chunk`` replicates of a key, whose blocks outweigh the key's own
    readings. Keys of more than ``size`` readings are resampled by joins and running counts, over many tasks.
    """
    key = ["entity_id", "side", "mode"]
    probs = [p for _, p in QUANTILES]
    rows = reads.filter("reading is not null").select(*key, "date", "reading")
    enough = table(rows.groupBy(*key).agg(F.count("*").alias("n"), F.percentile("reading", F.array(*map(F.lit, probs))).alias("t")).filter("n >= 100"), "enough")

    def run(drawn: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("date")["reading"].to_numpy(float)
        out = []
        for rep, of in drawn.groupby("rep"):
            at = np.concatenate([np.arange(a, a + m) for a, m in zip(of["start"], of["length"])]) % len(values)
            out.append(pd.DataFrame({"rep": rep, "i": range(len(probs)), "q": np.quantile(values[at], probs)}))
        out = pd.concat(out) if out else pd.DataFrame({"rep": [], "i": [], "q": []})
        return out.assign(**{k: pdf[k].iloc[0] if len(pdf) else None for k in key})[[*key, "rep", "i", "q"]]

    of = F.floor(F.col("rep") / chunk).cast("int").alias("chunk")
    brief = drawn_blocks(enough.filter(F.col("n") <= size).select(*key, "n"), key, n_boot, F.lit(block), seed).select("*", of)
    fanned = rows.join(small(enough.filter(F.col("n") <= size).select(*key)), key).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // chunk))))
    each = brief.groupBy(*key, "chunk").cogroup(fanned.groupBy(*key, "chunk")).applyInPandas(run, "entity_id string, side string, mode string, rep int, i int, q double")
    long = enough.filter(F.col("n") > size).select(*key, "n")
    if not long.isEmpty():
        numbered = blocked.indexed(rows.join(small(long.select(*key)), key), tuple(key), size=size)
        each = each.unionByName(_resampled(numbered, drawn_blocks(long, key, n_boot, F.lit(block), seed), key, probs))
    ci = each.groupBy(*key, "i").agg(F.percentile("q", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("ci"))
    names = F.array(*(F.lit(n) for n, _ in QUANTILES))
    lo, hi = F.get("ci", F.lit(0)), F.get("ci", F.lit(1))
    return ci.join(small(enough), key).select(*key, F.get(names, F.col("i")).alias("band"), F.get(F.array(*map(F.lit, probs)), F.col("i")).alias("quantile"), F.get("t", F.col("i")).alias("threshold"), lo.alias("lo"), hi.alias("hi"), (hi - lo).alias("width"))


def _resampled(numbered: DataFrame, drawn: DataFrame, key: list[str], probs: list[float]) -> DataFrame:
    """(key, rep, i, q): interpolated quantiles of the readings that each replicate's blocks hold, by running counts of equal readings."""
    places = drawn.select(*key, "n", "rep", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at")).withColumn("at", F.pmod("at", "n"))
    counts = places.join(numbered.select(*key, "at", "reading"), [*key, "at"]).groupBy(*key, "n", "rep", "reading").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*key, "rep").orderBy("reading").rowsBetween(Window.unboundedPreceding, 0))
    # the k-th reading from 0 on is the least one whose running count is over k
    rank = lambda p: F.lit(p) * (F.col("n") - 1)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("reading")))
    ends = [F.struct(at(F.floor(rank(p))).alias("a"), at(F.least(F.floor(rank(p)) + 1, F.col("n") - 1)).alias("b")) for p in probs]
    found = counts.withColumn("upto", upto).groupBy(*key, "n", "rep").agg(F.array(*ends).alias("e"))
    between = [F.col("e")[i]["a"] + (F.col("e")[i]["b"] - F.col("e")[i]["a"]) * (rank(p) - F.floor(rank(p))) for i, p in enumerate(probs)]
    return found.select(*key, "rep", F.posexplode(F.array(*between)).alias("i", "q"))


def binomial_quantiles(rates: DataFrame, max_inputs: int, quantiles: list[float]) -> DataFrame:
    """(entity_id, side, mode, k, quantile, reference): shares fired were k inputs independent, exactly.

    rates(entity_id, side, mode, fire_prob). The reference is the least j / k at which the binomial
    distribution function reaches the quantile; its terms are running sums of logarithms over j.
    """
    key = ["entity_id", "side", "mode"]
    p, k, j = F.col("fire_prob"), F.col("k"), F.col("j")
    cells = rates.select(*key, "fire_prob", F.explode(F.sequence(F.lit(2), F.lit(max_inputs))).alias("k")).withColumn("j", F.explode(F.sequence(F.lit(0), k)))
    upto = Window.partitionBy(*key, "k").orderBy("j")
    steps = F.sum(F.when(j > 0, F.ln((k - j + 1) / j) + F.ln(p / (1 - p))).otherwise(0.0)).over(upto)
    term = F.when(p <= 0, (j == 0).cast("double")).when(p >= 1, (j == k).cast("double")).otherwise(F.exp(k * F.ln(1 - p) + steps))
    cdf = cells.withColumn("pmf", term).withColumn("cdf", F.sum("pmf").over(upto))
    each = cdf.withColumn("quantile", F.explode(F.array(*map(F.lit, quantiles)))).filter(F.col("cdf") >= F.col("quantile") - 1e-12)
    return each.groupBy(*key, "k", "quantile").agg((F.min("j") / F.first("k")).alias("reference"))


def redundancy(reads: DataFrame, rates: DataFrame, nominal: int, quantile: float = 0.95) -> DataFrame:
    """(key, observed_quantile, nominal_k, effective_k, ratio): the k whose independent tail is nearest, least on ties."""
    key = ["entity_id", "side", "mode"]
    observed = reads.groupBy(*key).agg(F.percentile("reading", F.lit(quantile)).alias("observed_quantile"))
    reference = binomial_quantiles(rates, nominal, [quantile])
    near = reference.join(observed, key).groupBy(*key).agg(F.min(F.struct(F.abs(F.col("reference") - F.col("observed_quantile")).alias("gap"), "k")).alias("x"), F.first("observed_quantile").alias("observed_quantile"))
    return near.select(*key, "observed_quantile", F.lit(nominal).alias("nominal_k"), F.col("x.k").alias("effective_k"), (F.col("x.k") / nominal).alias("ratio"))


#: Published thresholds of the bands in a full evaluation.
PUBLISHED = (("Mild", 0.20), ("Moderate", 0.30), ("Strong", 0.40), ("Extreme", 0.50))


def thresholds(reads: DataFrame, n_boot: int | None = None) -> DataFrame:
    """(entity_id, side, mode, band, published, threshold, share_above[, lo, hi, width]): the bands of a full
    evaluation. threshold is calibrated on the readings, share_above the part of them at or over the published
    one; with ``n_boot`` also the bootstrap interval of the calibrated one (null under 100 readings)."""
    key = ["entity_id", "side", "mode"]
    shares = reads.groupBy(*key).agg(*((F.count_if(F.col("reading") >= t) / F.nullif(F.count("reading"), F.lit(0))).alias(n) for n, t in PUBLISHED))
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("band"), F.lit(t).alias("published"), F.col(n).alias("share_above")) for n, t in PUBLISHED)))
    out = shares.select(*key, named.alias("x")).select(*key, "x.*").join(calibrated(reads), [*key, "band"])
    if n_boot is None:
        return out
    ci = bootstrap_bands(reads, n_boot).select(*key, "band", "lo", "hi", "width")
    return out.join(ci, [*key, "band"], "left")


def full_evaluation(prices: DataFrame, signals: DataFrame, horizons: tuple[int, ...] = (21, 63, 126), n_boot: int = 300) -> DataFrame:
    """evaluate() at every horizon with the bootstrap interval; horizons without rows are absent. The bands
    that belong to it are thresholds() of the readings."""
    rows = table(paired(forward_returns(prices, list(horizons)), signals), "pairs")
    return evaluate(rows).join(bootstrap_lift(rows, n_boot), list(SIGNAL_KEY), "left")
