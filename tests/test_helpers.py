"""The numpy helpers against slow plain versions."""

import numpy as np
import pytest

from ebbmark.functions import helpers


@pytest.mark.parametrize("seed", range(3))
def test_causal_rank(seed):
    v = np.random.default_rng(seed).integers(0, 30, 200).astype(float)
    want = [np.nan if i + 1 < 20 else (v[: i + 1] <= v[i]).mean() for i in range(len(v))]
    np.testing.assert_allclose(helpers.causal_rank(v, 20), want)


def test_expanding_quantiles_with_gaps():
    v = np.random.default_rng(1).normal(size=150)
    v[::7] = np.nan
    got = helpers.expanding_quantiles(v, [0.5, 0.95], 30)
    for i in range(len(v)):
        seen = v[: i + 1][~np.isnan(v[: i + 1])]
        if len(seen) < 30:
            assert np.isnan(got[i]).all()
        else:
            np.testing.assert_allclose(got[i], np.quantile(seen, [0.5, 0.95]))


def test_rolling_pc1_against_svd():
    rng = np.random.default_rng(2)
    r = rng.normal(size=(120, 1)) @ np.ones((1, 4)) + 0.3 * rng.normal(size=(120, 4))
    r[5, 2] = np.nan
    got = helpers.rolling_pc1(r, 60)
    assert np.isnan(got[:60]).all()
    for i in (60, 90, 119):
        b = r[i - 60 : i]
        b = b[~np.isnan(b).any(axis=1)]
        z = (b - b.mean(0)) / b.std(0, ddof=1)
        load = np.linalg.svd(z, full_matrices=False)[2][0]
        load = -load if load[0] < 0 else load
        assert abs(got[i] - z[-1] @ load) < 1e-8


def test_newey_west_zero_lag_is_white_and_persistence_widens():
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(2000), rng.normal(size=2000)])
    y = 0.5 * x[:, 1] + rng.normal(size=2000)
    beta, se = helpers.newey_west(y, x, 0)
    assert abs(beta[1] - 0.5) < 0.1 and abs(se[1] - 1 / np.sqrt(2000)) < 0.005
    slow = np.convolve(rng.normal(size=2100), np.ones(60) / 60, "valid")[:2000]
    d = np.column_stack([np.ones(2000), slow > np.quantile(slow, 0.8)]).astype(float)
    y = np.convolve(rng.normal(size=2100), np.ones(63), "valid")[:2000]
    assert helpers.newey_west(y, d, 62)[1][1] > 1.25 * helpers.newey_west(y, d, 0)[1][1]



@pytest.mark.parametrize("n, window", [(0, 5), (3, 5), (400, 7), (1000, 300)])
def test_rolling_rank(n, window):
    v = np.random.default_rng(n).integers(0, 40, n).astype(float)
    want = [np.mean(v[max(0, i + 1 - window) : i + 1] <= v[i]) if min(i + 1, window) >= 4 else np.nan for i in range(n)]
    np.testing.assert_allclose(helpers.rolling_rank(v, window, 4, cells=1000), want)
    past = [np.mean(v[: i + 1] <= v[i]) if i >= 3 else np.nan for i in range(n)]
    np.testing.assert_allclose(helpers.causal_rank(v, 4, leaf=16), past)
