"""Least squares with autocorrelation-consistent errors, any number of regressors, as sums over rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbmark.core.tables import small, table
from ebbmark.functions import blocked


def newey_west(rows: DataFrame, y: str, xs: list[str], lags: int, key: tuple[str, ...] = ("entity_id",), size: int = blocked.ROWS) -> DataFrame:
    """(key, term, beta, se): y on a constant (term 0) and ``xs``, Bartlett kernel over ``lags`` rows.

    rows(key, date, y, xs); those with a null in y or xs are left out, keys with no more rows than terms give none.
    Collinear regressors share their part as the least-norm solution does. One group-by yields the moments, one small
    solve a key the coefficients and what a row's residual adds to each of them (its score). A term's variance is the
    kernel sum of its score alone: the squares of its moving totals over lags + 1 rows, by lags + 1. So each term
    needs one running total, and keys of more than ``size`` rows take theirs as a scan of blocks.
    """
    by, terms = list(key), range(len(xs) + 1)
    rows = rows.select(*by, "date", F.col(y).alias("y"), *(F.col(x).alias(f"x{i}") for i, x in enumerate(xs, 1))).dropna(subset=["y", *(f"x{i}" for i in terms[1:])])
    cov = lambda a, b: F.covar_pop(a, b)
    moments = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("y").alias("my"),
        F.array(*(F.avg(f"x{i}") for i in terms[1:])).alias("mx"),
        F.array(*(cov(f"x{min(i, j)}", f"x{max(i, j)}") for i in terms[1:] for j in terms[1:])).alias("cxx"),
        F.array(*(cov(f"x{i}", "y") for i in terms[1:])).alias("cxy"),
    )
    solved = _solver(len(xs))("n", "my", "mx", "cxx", "cxy").alias("fit")
    fits = table(moments.filter(F.col("n") > len(xs) + 1).select(*by, "n", "mx", solved).select(*by, "n", "mx", "fit.*"), "fits")
    off = [F.lit(1.0), *(F.col(f"x{i}") - F.get("mx", F.lit(i - 1)) for i in terms[1:])]
    met = rows.join(small(fits), by)
    left = F.col("y") - sum((F.get("line", F.lit(i)) * x for i, x in enumerate(off)), F.lit(0.0))
    share = lambda j: sum((F.get("weights", F.lit(j * len(terms) + i)) * x for i, x in enumerate(off)), F.lit(0.0))
    scores = met.select(*by, "date", "n", *((share(j) * left).alias(f"g{j}") for j in terms))
    summed = _moving_squares(scores, [f"g{j}" for j in terms], lags, key, size)
    variance = summed.groupBy(*by).agg(*((F.sum(f"g{j}") / (lags + 1)).alias(f"v{j}") for j in terms))
    each = F.explode(F.array(*(F.struct(F.lit(j).alias("term"), F.get("beta", F.lit(j)).alias("beta"), F.sqrt(F.greatest(F.col(f"v{j}"), F.lit(0.0))).alias("se")) for j in terms)))
    return fits.join(small(variance), by).select(*by, each.alias("x")).select(*by, "x.*")


def _solver(k: int):
    """(n, mean y, means, covariances) -> beta; line: the fit as (value at the means, slopes); weights, row-wise: a
    row's score for term j is the j-th row of weights times (1, x - means), times its residual."""

    @F.pandas_udf("beta array<double>, line array<double>, weights array<double>")
    def solve(n: pd.Series, my: pd.Series, mx: pd.Series, cxx: pd.Series, cxy: pd.Series) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({"beta": [], "line": [], "weights": []})
        rows = n.to_numpy(float)[:, None, None]
        m, c, b = (np.stack([np.asarray(v, float) for v in s]).reshape(len(n), k, w) for s, w in ((mx, 1), (cxx, k), (cxy, 1)))
        at = my.to_numpy(float)[:, None, None]
        # a constant and centred regressors: the constant meets none of them
        inverse = np.linalg.pinv(c, hermitian=True)
        slopes = inverse @ b
        shift = np.concatenate([np.ones((len(n), 1, 1)), -np.swapaxes(m, 1, 2) @ inverse], axis=2)
        weights = np.concatenate([shift, np.concatenate([np.zeros((len(n), k, 1)), inverse], axis=2)], axis=1) / rows
        beta = np.concatenate([at - np.swapaxes(m, 1, 2) @ slopes, slopes], axis=1)
        sd = np.sqrt(np.maximum(np.einsum("ijj->ij", c), 0.0))
        unit = np.where(sd > 0, sd, 1.0)
        flat = np.linalg.matrix_rank(c / unit[:, :, None] / unit[:, None, :], tol=1e-10, hermitian=True) < k
        for i in np.flatnonzero(flat):  # collinear: the least-norm solution in the units given
            one = np.concatenate([[1.0], m[i, :, 0]])
            gram = rows[i, 0, 0] * (np.outer(one, one) + np.pad(c[i], (1, 0)))
            full = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
            beta[i, :, 0] = full @ (rows[i, 0, 0] * (one * at[i, 0, 0] + np.concatenate([[0.0], b[i, :, 0]])))
            centre = np.eye(k + 1)
            centre[1:, 0] = m[i, :, 0]
            weights[i] = full @ centre
        line = np.concatenate([beta[:, :1] + np.swapaxes(m, 1, 2) @ beta[:, 1:], beta[:, 1:]], axis=1)
        return pd.DataFrame({"beta": list(beta[:, :, 0]), "line": list(line[:, :, 0]), "weights": list(weights.reshape(len(n), -1))})

    return solve


def _moving_squares(rows: DataFrame, values: list[str], lags: int, key: tuple[str, ...], size: int) -> DataFrame:
    """rows(key, date, n, values) with each value replaced by the squares of the moving totals over lags + 1 rows that
    end at its row, and at the row ``lags`` + 1 later where that lies beyond the end. Values add up to zero."""
    short, long, _ = blocked.by_length(rows, key, size)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("date")) - 1
    upto = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)

    def squared(df: DataFrame, *by: str) -> DataFrame:
        before = Window.partitionBy(*key, *by).orderBy("at")
        return df.withColumns({f"__{v}": F.coalesce(F.lag(f"run_{v}", lags + 1).over(before), F.lit(0.0)) for v in values})

    near = short.withColumn("at", place.cast("long"))
    out = squared(near.withColumns({f"run_{v}": F.sum(v).over(upto) for v in values})).select(*key, "at", "n", *values, *(f"{p}{v}" for v in values for p in ("run_", "__")))
    if long is not None:
        runs = table(blocked.running_sum(blocked.indexed(long, key, size=size), key, values, size), "runs")
        far = squared(blocked.with_halo(runs, lags + 1, size), "blk").filter("not halo")
        out = out.unionByName(far.select(F.col("at").cast("long").alias("at"), *(c for c in out.columns if c != "at")))
    total = lambda v: F.col(f"run_{v}") - F.col(f"__{v}")
    rest = lambda v: F.when((F.col("at") > 0) & (F.col("at") >= F.col("n") - lags), F.col(f"run_{v}") - F.col(v)).otherwise(0.0)
    return out.select(*key, *((total(v) * total(v) + rest(v) * rest(v)).alias(v) for v in values))
