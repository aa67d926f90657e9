"""Small vectorised helpers for what built-in functions would do in quadratic time.

Each is a pure numpy function; the wrappers in ``grouped`` run them per series or basket.
"""

from __future__ import annotations

import numpy as np


def count_at_most(values: np.ndarray, limits: np.ndarray, leaf: int = 128) -> np.ndarray:
    """For each row, how many values up to it, its own included, are <= its limit. O(n log^2 n).

    Counts within leaves, then of every right half in its sorted left half, doubling the width.
    """
    n = len(values)
    count = np.zeros(n, np.int64)
    for a in range(0, n, leaf):
        count[a : a + leaf] = np.tril(values[None, a : a + leaf] <= limits[a : a + leaf, None]).sum(axis=1)
    width = leaf
    while width < n:
        for a in range(0, n - width, 2 * width):
            count[a + width : a + 2 * width] += np.searchsorted(np.sort(values[a : a + width]), limits[a + width : a + 2 * width], "right")
        width *= 2
    return count


def causal_rank(values: np.ndarray, min_periods: int, leaf: int = 128) -> np.ndarray:
    """Share of the values so far that are <= the current one; NaN before min_periods."""
    seen = np.arange(1, len(values) + 1)
    return np.where(seen >= min_periods, count_at_most(values, values, leaf) / seen, np.nan)


def rolling_rank(values: np.ndarray, window: int, min_periods: int, cells: int = 1 << 22) -> np.ndarray:
    """Share of the last ``window`` values that are <= the current one; blocks of at most ``cells`` comparisons."""
    n = len(values)
    if not n:
        return np.empty(0)
    padded = np.concatenate([np.full(window - 1, np.nan), values])  # NaN is <= nothing
    views = np.lib.stride_tricks.sliding_window_view(padded, window)
    rows = max(1, cells // window)
    count = np.concatenate([np.empty(0, np.int64), *((views[a : a + rows] <= values[a : a + rows, None]).sum(axis=1) for a in range(0, n, rows))])
    seen = np.minimum(np.arange(1, n + 1), window)
    return np.where(seen >= min_periods, count / seen, np.nan)


def kth_smallest(values: np.ndarray, upto: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each question, the k-th smallest (from 0) of the first ``upto`` values, by a wavelet matrix of their ranks.

    Bit by bit from the highest, zeros are moved before ones; a question follows its k to one side. All
    questions take a step together, so the cost is (values + questions) log values.
    """
    n = len(values)
    order = np.argsort(values, kind="stable")
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    lo, hi, k, rank = np.zeros(len(k), np.int64), np.array(upto, np.int64), np.array(k, np.int64), np.zeros(len(k), np.int64)
    for bit in range(max(n - 1, 1).bit_length() - 1, -1, -1):
        one = (row >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        below = zeros[hi] - zeros[lo]
        up = k >= below
        k = np.where(up, k - below, k)
        rank |= up.astype(np.int64) << bit
        lo, hi = (np.where(up, zeros[-1] + x - zeros[x], zeros[x]) for x in (lo, hi))
        row = np.concatenate([row[~one], row[one]])
    return values[order[rank]] if n else np.empty(0)


def expanding_quantiles(values: np.ndarray, probs: list[float], min_periods: int) -> np.ndarray:
    """Linear-interpolated quantiles of the non-missing values so far, one column per probability."""
    out = np.full((len(values), len(probs)), np.nan)
    real = ~np.isnan(values)
    seen = np.cumsum(real)
    rows = np.flatnonzero(seen >= max(min_periods, 1))
    n = seen[rows]
    for j, p in enumerate(probs):
        at = p * (n - 1)
        lo = np.floor(at).astype(np.int64)
        a, b = np.split(kth_smallest(values[real], np.tile(n, 2), np.concatenate([lo, np.minimum(lo + 1, n - 1)])), 2)
        out[rows, j] = a + (b - a) * (at - lo)
    return out


def rolling_pc1(returns: np.ndarray, window: int, cells: int = 1 << 22) -> np.ndarray:
    """Score of the last complete row of each preceding block on its first principal component.

    Row i sees rows i - window to i - 1. The component's sign makes the first column's loading positive. Moments
    of every block are differences of running sums over the complete rows; correlation matrices are decomposed
    together, some ``cells`` numbers at once. A column that is constant in a block has no part in it.
    """
    n, k = returns.shape
    out = np.full(n, np.nan)
    full = ~np.isnan(returns).any(axis=1)
    ends = np.arange(window, n)
    if not full.any() or not len(ends) or k < 2:
        return out
    x = np.where(full[:, None], returns - returns[full].mean(axis=0), 0.0)  # a common shift leaves the result
    last = np.maximum.accumulate(np.where(full, np.arange(n), -1))
    held = np.concatenate([[0], np.cumsum(full)])
    change = np.where(full[1:] & (last[:-1] >= 0), 1, 0)  # where a column's value differs from the complete row before
    moved = np.concatenate([np.zeros((1, k)), np.cumsum(change[:, None] & (returns[1:] != returns[np.maximum(last[:-1], 0)]), axis=0)])
    first = np.minimum.accumulate(np.where(full, np.arange(n), n)[::-1])[::-1]
    step = max(1, cells // (k * k))
    run = np.concatenate([np.zeros((1, k)), np.cumsum(x, axis=0)])
    for a in range(0, len(ends), step):
        e = ends[a : a + step]
        s = e - window
        m = held[e] - held[s]
        ok = m >= max(window // 2, 2)
        e, s, m = e[ok], s[ok], m[ok]
        if not len(e):
            continue
        base = s[0]
        cross = np.concatenate([np.zeros((1, k, k)), np.cumsum(x[base : e[-1], :, None] * x[base : e[-1], None, :], axis=0)])
        mean = (run[e] - run[s]) / m[:, None]
        cov = (cross[e - base] - cross[s - base] - m[:, None, None] * mean[:, :, None] * mean[:, None, :]) / (m - 1)[:, None, None]
        varies = moved[last[e - 1]] > moved[np.minimum(first[s], n - 1)]
        sd = np.sqrt(np.maximum(np.where(varies, np.einsum("ijj->ij", cov), 0.0), 0.0))
        inverse = np.where(varies & (sd > 0), 1 / np.where(sd > 0, sd, 1), 0.0)
        load = np.linalg.eigh(cov * inverse[:, :, None] * inverse[:, None, :])[1][:, :, -1]
        load = np.where(load[:, :1] < 0, -load, load)
        score = (((x[last[e - 1]] - mean) * inverse) * load).sum(axis=1)
        out[e] = np.where((inverse > 0).sum(axis=1) >= 2, score, np.nan)
    return out


def newey_west(y: np.ndarray, x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """OLS coefficients and their Bartlett-kernel autocorrelation-consistent standard errors."""
    bread = np.linalg.pinv(x.T @ x)
    beta = bread @ (x.T @ y)
    u = x * (y - x @ beta)[:, None]
    meat = u.T @ u
    for lag in range(1, min(lags, len(u) - 1) + 1):
        cross = u[lag:].T @ u[:-lag]
        meat += (1 - lag / (lags + 1)) * (cross + cross.T)
    return beta, np.sqrt(np.maximum(np.diag(bread @ meat @ bread), 0.0))
