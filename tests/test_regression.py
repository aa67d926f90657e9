"""Regressions as sums over rows against the plain helper."""

import datetime

import numpy as np
import pytest

from ebbmark.functions import helpers
from ebbmark.operators import regression

DAY = datetime.date(2020, 1, 1)


def table_of(spark, series):
    rows = [(e, DAY + datetime.timedelta(days=i), *(None if v is None else float(v) for v in r)) for e, rs in series.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "entity_id string, date date, y double, a double, b double")


def check(spark, series, lags, size):
    got = {(r.entity_id, r.term): (r.beta, r.se) for r in regression.newey_west(table_of(spark, series), "y", ["a", "b"], lags, size=size).collect()}
    want = {}
    for e, rs in series.items():
        full = np.array([r for r in rs if None not in r], float)
        if len(full) > 3:
            x = np.column_stack([np.ones(len(full)), full[:, 1:]])
            want.update({(e, t): v for t, v in enumerate(zip(*helpers.newey_west(full[:, 0], x, lags)))})
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("lags,size", [(0, 1 << 18), (7, 1 << 18), (7, 50), (60, 50), (400, 1 << 18)])
def test_terms_equal_the_plain_helper(spark, lags, size):
    rng = np.random.default_rng(5)
    series = {}
    for e, n in (("long", 333), ("short", 40), ("four", 4), ("three", 3)):
        x = rng.normal(size=(n, 2)) * [1, 30] + [5, -100]
        y = 0.3 * x[:, 0] - 0.01 * x[:, 1] + np.convolve(rng.normal(size=n + 9), np.ones(10), "valid")
        series[e] = [list(r) for r in np.column_stack([y, x])]
    for i in (3, 50, 51):
        series["long"][i][i % 3] = None
    check(spark, series, lags, size)


def test_collinear_and_constant_regressors_take_the_least_norm(spark):
    rng = np.random.default_rng(6)
    a, y = rng.normal(size=90), rng.normal(size=90)
    check(spark, {"twice": [[v, w, 2 * w] for v, w in zip(y, a)], "fixed": [[v, w, 3.0] for v, w in zip(y, a)]}, 5, 1 << 18)


def test_empty_table(spark):
    assert regression.newey_west(table_of(spark, {}), "y", ["a", "b"], 5).collect() == []
