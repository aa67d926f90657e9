"""Transforms of series: obs(entity_id, series_id, date, value) in, the same columns out.

Row offsets count null rows, so nothing is filtered before a lag. Each transform is one window
partitioned by series; chains on one series add no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbmark.core.windows import KEY, expanding, held, month_rows, ordered, ratio, rolling
from ebbmark.functions import grouped

MAD_SCALE = 1.4826
#: Rows of a series beyond which the quadratic built-in frames give way to the sorted-insert helper.
LONG = 10_000


def _with(obs: DataFrame, value: Column) -> DataFrame:
    return obs.select(*KEY, "date", value.alias("value"))


def returns(obs: DataFrame, pad: bool = False) -> DataFrame:
    """v / v[t-1] - 1; with ``pad`` the last value before a gap is carried forward first."""
    if pad:
        obs = _with(obs, F.last("value", ignorenulls=True).over(expanding()))
    return _with(obs, ratio(F.col("value"), F.lag("value").over(ordered())) - 1)


def diff_horizon(obs: DataFrame, months: float, freq: str = "daily") -> DataFrame:
    return _with(obs, F.col("value") - F.lag("value", month_rows(months, freq)).over(ordered()))


def smooth(obs: DataFrame, months: float, freq: str = "daily") -> DataFrame:
    n = month_rows(months, freq)
    return _with(obs, held(F.avg("value"), "value", rolling(n), max(n // 2, 1)))


def robust_z(obs: DataFrame, window: int | None = None, clip: float = 3.0, long_series: bool = False) -> DataFrame:
    """Median / MAD z-score, clipped; null where the MAD is zero.

    ``long_series`` computes the expanding medians by sorted insertion instead of frames.
    """
    if window is not None and window < 30:
        raise ValueError("a robust z needs a window of 30 rows or more")
    if window is None and long_series:
        med = grouped.expanding_quantiles(obs, [0.5], 30).withColumn("med", F.get("quantiles", F.lit(0))).drop("quantiles")
        dev = med.select(*KEY, "date", F.abs(F.col("value") - F.col("med")).alias("value"))
        mad = grouped.expanding_quantiles(dev, [0.5], 30).select(*KEY, "date", F.get("quantiles", F.lit(0)).alias("mad"))
        both = med.join(mad, [*KEY, "date"])
    else:
        over, least = (expanding(), 30) if window is None else (rolling(window), max(window // 4, 30))
        median = lambda c: held(F.percentile(c, F.lit(0.5)), c, over, least)
        both = obs.select(*KEY, "date", "value").withColumn("med", median("value")).withColumn("dev", F.abs(F.col("value") - F.col("med"))).withColumn("mad", median("dev"))
    z = ratio(F.col("value") - F.col("med"), MAD_SCALE * F.col("mad"))
    return _with(both, F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z))))


def rolling_beta(y: DataFrame, x: DataFrame, window: int) -> DataFrame:
    """OLS beta of y's returns on x's over ``window`` complete pairs, on y's dates.

    x has one series per entity; every series of y is paired with it.
    """
    ry = returns(y).withColumnRenamed("value", "ry")
    rx = returns(x).select("entity_id", "date", F.col("value").alias("rx"))
    pairs = ry.join(rx, ["entity_id", "date"]).filter("ry is not null and rx is not null")
    over = rolling(window)
    slope = F.when(F.count("rx").over(over) >= window, F.regr_slope("ry", "rx").over(over))
    beta = pairs.select(*KEY, "date", slope.alias("value"))
    return y.select(*KEY, "date").join(beta, [*KEY, "date"], "left")


def rsi(obs: DataFrame, window: int = 14) -> DataFrame:
    delta = F.col("value") - F.lag("value").over(ordered())
    moves = obs.select(*KEY, "date", delta.alias("d"))
    up, down = (F.when(F.col("d").isNotNull(), F.greatest(s * F.col("d"), F.lit(0.0))) for s in (1, -1))
    moves = moves.withColumns({"up": up, "down": down})
    means = moves.withColumns({c: held(F.avg(c), c, rolling(window), window) for c in ("up", "down")})
    value = F.when(F.col("down") == 0, 100.0).otherwise(100 - 100 / (1 + ratio(F.col("up"), F.col("down"))))
    return _with(means, F.when(F.col("down").isNotNull(), value))


def realised_vol(obs: DataFrame, window: int = 60, annual: int = 252) -> DataFrame:
    r = returns(obs)
    return _with(r, held(F.stddev_samp("value"), "value", rolling(window), window) * F.sqrt(F.lit(float(annual))))


def vol_target_weight(obs: DataFrame, target: float = 0.10, window: int = 60, cap: float = 3.0) -> DataFrame:
    w = ratio(F.lit(target), F.col("value"))
    return _with(realised_vol(obs, window), F.when(w.isNotNull(), F.least(w, F.lit(cap))))


def inverse_vol_weights(sleeves: DataFrame, window: int = 60) -> DataFrame:
    """Weights across an entity's series at each date; a series without volatility leaves the sum."""
    inv = _with(realised_vol(sleeves, window), ratio(F.lit(1.0), F.col("value")))
    return _with(inv, ratio(F.col("value"), F.sum("value").over(Window.partitionBy("entity_id", "date"))))


def mean_of_z(legs: DataFrame, directions: DataFrame, window: int | None = None) -> DataFrame:
    """(entity_id, date, value): mean z over legs; directions(series_id, invert) is a small table."""
    z = robust_z(legs, window).join(F.broadcast(directions), "series_id")
    return z.groupBy("entity_id", "date").agg(F.avg(F.when(F.col("invert"), -F.col("value")).otherwise(F.col("value"))).alias("value"))


def first_principal_component(obs: DataFrame, series: list[str], window: int = 252) -> DataFrame:
    """(entity_id, date, value); the sign follows the first series of the list."""
    return grouped.first_component(returns(obs), series, window)


def trend_replication(obs: DataFrame, lookbacks: tuple[int, ...] = (21, 63, 252), vol_window: int = 60, cap: float = 2.0) -> DataFrame:
    """Volatility-scaled momentum, averaged over the lookbacks that are available."""
    vol = realised_vol(obs, vol_window).withColumnRenamed("value", "vol")
    moves = obs.select(*KEY, "date", *((ratio(F.col("value"), F.lag("value", n).over(ordered())) - 1).alias(f"m{n}") for n in lookbacks))
    both = moves.join(vol, [*KEY, "date"])
    signal = lambda n: F.signum(f"m{n}") * F.when(F.col("vol").isNotNull(), F.least(ratio(F.abs(f"m{n}"), F.col("vol")), F.lit(cap)))
    parts = F.array_compact(F.array(*(F.when(F.col(f"m{n}").isNotNull() & (F.col("vol") != 0), signal(n)) for n in lookbacks)))
    total = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    return _with(both, F.when(F.size(parts) > 0, total / F.size(parts)))


def ratio_of(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """a / b by entity and date, as series ``name``; a and b have one series per entity."""
    both = a.select("entity_id", "date", F.col("value").alias("a")).join(b.select("entity_id", "date", F.col("value").alias("b")), ["entity_id", "date"])
    return both.select("entity_id", F.lit(name).alias("series_id"), "date", ratio(F.col("a"), F.col("b")).alias("value"))


def basket_mean(obs: DataFrame, name: str) -> DataFrame:
    """Mean over an entity's series at each date (of RSIs, say)."""
    return obs.groupBy("entity_id", "date").agg(F.avg("value").alias("value")).select("entity_id", F.lit(name).alias("series_id"), "date", "value")


def basket_sum(obs: DataFrame, name: str) -> DataFrame:
    return obs.groupBy("entity_id", "date").agg(F.sum("value").alias("value")).select("entity_id", F.lit(name).alias("series_id"), "date", "value")


def weighted_basket(obs: DataFrame, weights: DataFrame, name: str) -> DataFrame:
    """sum(value * weight) / sum(weight) per date; weights(entity_id, series_id, date, weight)."""
    both = obs.join(weights, [*KEY, "date"]).filter("value is not null and weight is not null")
    w = ratio(F.sum(F.col("value") * F.col("weight")), F.sum("weight"))
    return both.groupBy("entity_id", "date").agg(w.alias("value")).select("entity_id", F.lit(name).alias("series_id"), "date", "value")


def chain(obs: DataFrame, op: str, smooth_months: float | None = None, diff_months: float | None = None, freq: str = "daily", **args) -> DataFrame:
    """An input's recipe: a transform, then smoothing, then a difference (or the level).

    Inputs that share op and windows go through one call, so one pass serves many series.
    """
    ops = {"direct": lambda o: o.select(*KEY, "date", "value"), "returns": returns, "robust_z": robust_z, "rsi": rsi, "realised_vol": realised_vol, "vol_target_weight": vol_target_weight, "inverse_vol_weights": inverse_vol_weights, "trend": trend_replication}
    out = ops[op](obs, **args)
    if smooth_months:
        out = smooth(out, smooth_months, freq)
    return diff_horizon(out, diff_months, freq) if diff_months else out
