"""Correlations of an entity's inputs from matrices of products, against pandas."""

import datetime

import numpy as np
import pandas as pd
import pytest

from ebbmark.operators import readings


@pytest.mark.parametrize("days,width", [(512, 256), (30, 2), (7, 1)])
def test_pairs_equal_pandas(spark, days, width):
    rng = np.random.default_rng(3)
    want, rows = {}, []
    for entity, n in (("e", 90), ("f", 40)):
        base = rng.normal(size=n)
        wide = pd.DataFrame({f"s{i}": 1e6 + base * i + rng.normal(size=n) for i in range(5)})
        wide["fixed"] = 7.0
        wide = wide.mask(rng.random(wide.shape) < 0.2)
        wide.index = [datetime.date(2020, 1, 1) + datetime.timedelta(days=3 * i) for i in range(n)]
        corr = wide.corr(min_periods=2)
        want.update({(entity, a, b): corr.loc[a, b] for a in wide for b in wide if a < b and corr.loc[a, b] >= -0.9})
        rows += [(entity, s, d, None if np.isnan(v) else float(v)) for s in wide for d, v in wide[s].items()]
    obs = spark.createDataFrame(rows, "entity_id string, series_id string, date date, value double")
    got = {(r.entity_id, r.id_a, r.id_b): r.corr for r in readings.correlated(obs, -0.9, days, width).collect()}
    assert got.keys() == want.keys() and len(got) == 20
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert readings.correlated(obs.limit(0)).collect() == []
