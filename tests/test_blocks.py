"""Long series in blocks against one task a series and against plain versions."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbmark.core.windows import KEY
from ebbmark.functions import blocked, grouped, helpers
from ebbmark.operators import triggers

DAY = datetime.date(2000, 1, 1)


def series(name, values):
    return [("e", name, DAY + datetime.timedelta(i), None if v is None or np.isnan(v) else float(v)) for i, v in enumerate(values)]


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(4)
    gaps = rng.normal(size=700)
    gaps[::9] = np.nan
    rows = series("walk", np.cumsum(rng.normal(size=1500))) + series("zeros", np.where(rng.random(900) < 0.5, 0, rng.integers(-3, 9, 900))) + series("gaps", gaps) + series("flat", np.ones(400))
    rows += series("void", [np.nan] * 300) + [r for i in range(30) for r in series(f"s{i}", rng.normal(size=20 + i))]
    return spark.createDataFrame(rows, "entity_id string, series_id string, date date, value double").repartition(5).cache()


def plain(df, value):
    return sorted((r.series_id, r.date, None if r[value] is None else np.round(r[value], 9).tolist()) for r in df.collect())


def test_row_numbers(obs):
    got = blocked.indexed(obs, KEY, size=100)
    want = {}
    for r in sorted(obs.collect(), key=lambda r: (r.series_id, r.date)):
        want[r.series_id, r.date] = sum(1 for k in want if k[0] == r.series_id)
    assert {(r.series_id, r.date): r.at for r in got.collect()} == want


@pytest.mark.parametrize("size", [50, 333])
def test_ranks_in_blocks_equal_one_task_a_series(obs, size):
    assert plain(grouped.past_rank(obs, None, 60, size=size), "rank") == plain(grouped.past_rank(obs, None, 60), "rank")


@pytest.mark.parametrize("window", [7, 120])
def test_rolling_ranks_in_blocks(obs, window):
    assert plain(grouped.past_rank(obs, window, 5, size=64), "rank") == plain(grouped.past_rank(obs, window, 5), "rank")


@pytest.mark.parametrize("size", [50, 400])
def test_quantiles_in_blocks_equal_one_task_a_series(obs, size):
    probs = [0.0, 0.3, 0.5, 0.95, 1.0]
    assert plain(grouped.expanding_quantiles(obs, probs, 30, size=size), "quantiles") == plain(grouped.expanding_quantiles(obs, probs, 30), "quantiles")


def test_later_rows_do_not_change_earlier_ones(obs):
    cut = F.col("date") < DAY + datetime.timedelta(500)
    for f, value in ((lambda o: grouped.past_rank(o, None, 60, size=100), "rank"), (lambda o: grouped.expanding_quantiles(o, [0.5], 30, size=100), "quantiles")):
        changed = obs.withColumn("value", F.when(cut, F.col("value")).otherwise(F.col("value") * 10))
        assert plain(f(obs).filter(cut), value) == plain(f(changed).filter(cut), value)


def test_scans_of_blocks(obs):
    numbered = blocked.indexed(obs, KEY, size=100)
    sums = {(r.series_id, r.date): r.run_value for r in blocked.running_sum(numbered, KEY, ["value"], 64).collect()}
    lasts = {(r.series_id, r.date): r.value for r in blocked.last_known(numbered, KEY, "value", 64).collect()}
    total, last = {}, {}
    for r in sorted(obs.collect(), key=lambda r: (r.series_id, r.date)):
        total[r.series_id] = total.get(r.series_id, 0.0) + (r.value or 0.0)
        last[r.series_id] = r.value if r.value is not None else last.get(r.series_id)
        assert abs(sums[r.series_id, r.date] - total[r.series_id]) < 1e-9 and lasts[r.series_id, r.date] == last[r.series_id]


def test_no_task_holds_a_long_series(spark):
    """A series of 200,000 rows in blocks of 12,500: every group that a helper sees is at most some blocks long."""
    rows = spark.range(200_000).select(F.lit("e").alias("entity_id"), F.lit("s").alias("series_id"), F.col("id").alias("date"), (F.xxhash64("id") % 1000).cast("double").alias("value"))
    numbered = blocked.indexed(rows, KEY, size=12_500)
    sizes = [r["count"] for r in numbered.withColumn("blk", blocked.block_of(12_500)).groupBy("blk").count().collect()]
    assert len(sizes) == 16 and set(sizes) == {12_500}
    got = {r.date: r["rank"] for r in triggers.causal_rank(rows, size=12_500).collect()}
    values = np.array([r.value for r in rows.orderBy("date").collect()])
    want = helpers.causal_rank(values, 252)
    assert all(got[i] is None and np.isnan(w) or abs(got[i] - w) < 1e-12 for i, w in enumerate(want))


def test_kth_smallest():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 9, 300).astype(float)
    t = rng.integers(1, 301, 500)
    k = (rng.random(500) * t).astype(int)
    assert helpers.kth_smallest(v, t, k).tolist() == [np.sort(v[:a])[b] for a, b in zip(t, k)]
    assert helpers.kth_smallest(np.array([3.0]), np.array([1]), np.array([0])).tolist() == [3.0]


def test_a_million_expanding_quantiles_take_seconds():
    import time

    began = time.time()
    out = helpers.expanding_quantiles(np.random.default_rng(0).normal(size=1_000_000), [0.5, 0.95], 30)
    assert time.time() - began < 20 and abs(out[-1, 0]) < 0.01


def test_first_component_leaves_out_constant_columns():
    rng = np.random.default_rng(2)
    r = rng.normal(size=(90, 4))
    r[10:60, 0] = 0.1
    r[70, 1] = np.nan
    got = helpers.rolling_pc1(r, 30)
    for i in (45, 55, 75, 89):
        b = r[i - 30 : i]
        b = b[~np.isnan(b).any(axis=1)]
        sd = b.std(0, ddof=1)
        keep = (b != b[0]).any(axis=0)
        z = ((b - b.mean(0)) / np.where(keep, sd, 1))[:, keep]
        load = np.linalg.svd(z, full_matrices=False)[2][0]
        want = z[-1] @ load
        assert abs(got[i] - want) < 1e-8 or not keep[0] and abs(got[i] + want) < 1e-8 or abs(got[i] - want * np.sign(load[0])) < 1e-8
