"""Properties of the signal operators on generated series."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbmark.core import schemas
from ebbmark.functions import transforms as T
from ebbmark.operators import alignment, evaluation, positioning, readings, series_quality, triggers

D0 = datetime.date(2004, 1, 1)


def day(i):
    return D0 + datetime.timedelta(days=int(i))


def series(spark, **named):
    rows = [("e", name, day(i), None if v is None else float(v)) for name, vs in named.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, schemas.OBS)


def values(df, col="value", name=None):
    rows = df if name is None else df.filter(F.col("series_id") == name)
    return [r[0] for r in rows.orderBy("date").select(col).collect()]


def walk(n, seed):
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0.0003, 0.01, n)))


@pytest.mark.parametrize(
    "f",
    [
        lambda o: triggers.causal_rank(o, min_periods=50).withColumnRenamed("rank", "value"),
        lambda o: triggers.causal_rank(o, 60, 50).withColumnRenamed("rank", "value"),
        lambda o: T.robust_z(o, 60),
        lambda o: T.robust_z(o, long_series=True),
        lambda o: T.diff_horizon(o, 1),
        lambda o: T.smooth(o, 1),
        lambda o: T.rsi(o),
        lambda o: T.vol_target_weight(o),
        lambda o: T.trend_replication(o, (5, 21), 20),
        lambda o: T.chain(o, "rsi", 1, 1),
    ],
)
def test_nothing_looks_ahead(spark, f):
    v = walk(220, 1)
    later = v.copy()
    later[170:] *= 10
    a, b = values(f(series(spark, x=v))), values(f(series(spark, x=later)))
    assert a[:170] == b[:170] and a[170:] != b[170:]


def test_ranks(spark):
    up, down = series(spark, x=range(300)), series(spark, x=range(300, 0, -1))
    assert set(values(triggers.causal_rank(up, min_periods=100), "rank")[99:]) == {1.0}
    assert values(triggers.causal_rank(down, min_periods=100), "rank")[-1] == pytest.approx(1 / 300)
    gaps = series(spark, x=[None if i % 3 == 0 else i % 17 for i in range(200)])
    fast, slow = (values(triggers.causal_rank(gaps, min_periods=30, long_series=x), "rank") for x in (True, False))
    assert fast == slow and len(fast) == 133


def test_hinge_and_fired(spark):
    rows = [("gt", 90.0, r) for r in (0.0, 0.5, 0.9, 0.95, 1.0, None)] + [("lt", 10.0, r) for r in (0.0, 0.05, 0.1, 0.5, 1.0, None)]
    df = spark.createDataFrame(rows, "rule string, pct double, rank double")
    c = (F.col("rank"), F.col("rule"), F.col("pct"))
    out = df.select(triggers.hinge(*c), triggers.fired(*c)).collect()
    assert [r[0] and round(r[0], 9) for r in out] == [0, 0, 0, 0.5, 1, None, 1, 0.5, 0, 0, 0, None]
    assert [r[1] for r in out] == [False, False, True, True, True, None, True, True, True, False, False, None]


def test_transforms(spark):
    noise = np.random.default_rng(2).normal(size=800)
    spiked = noise.copy()
    spiked[400] = 60
    a, b = values(T.robust_z(series(spark, x=noise), 252)), values(T.robust_z(series(spark, x=spiked), 252))
    assert b[400] == 3.0 and max(abs(x - y) for x, y in zip(a[401:], b[401:])) < 0.15
    assert values(T.diff_horizon(series(spark, x=range(99)), 3))[-1] == 63
    assert set(values(T.rsi(series(spark, x=range(1, 60))))[14:]) == {100.0}
    y = walk(200, 3)
    lev = 100 * np.cumprod(1 + 2 * np.diff(y, prepend=y[0]) / np.r_[y[0], y[:-1]])
    beta = values(T.rolling_beta(series(spark, y=lev), series(spark, x=y), 20))
    assert beta[-1] == pytest.approx(2, abs=1e-6) and beta[5] is None
    twins = series(spark, a=noise, b=noise)
    mean = T.mean_of_z(twins, spark.createDataFrame([("a", False), ("b", True)], "series_id string, invert boolean"), 252)
    assert all(v is None or abs(v) < 1e-12 for v in values(mean))
    assert values(T.robust_z(series(spark, x=[1.0] * 200), 60))[-1] is None
    first = next(i for i, v in enumerate(values(T.robust_z(series(spark, x=noise[:120])))) if v is not None)
    assert first == 58
    with pytest.raises(ValueError):
        T.robust_z(twins, 20)
    weights = T.inverse_vol_weights(series(spark, a=walk(120, 5), b=walk(120, 6)))
    assert weights.filter("value is not null").groupBy("date").agg(F.sum("value").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0


def made_reads(spark, n=400, k=6, gone=None, same=False):
    rng = np.random.default_rng(8)
    common = rng.normal(size=n)
    named = {f"in{i}": [None] * n if i == gone else (common + rng.normal(0, 0.05, n) if same else rng.normal(size=n)) for i in range(k)}
    ranks = triggers.causal_rank(series(spark, **named), min_periods=100).withColumnRenamed("series_id", "input_id")
    rules = spark.createDataFrame([(f"in{i}", s, r, p, "expanding", None, 100) for i in range(k) for s, r, p in (("sell", "gt", 90.0), ("buy", "lt", 10.0))], schemas.RULES)
    inputs = spark.createDataFrame([(f"in{i}", f"c{i % 3}") for i in range(k)], schemas.INPUTS)
    return readings.readings(readings.input_grid(ranks, rules, inputs)), ranks, rules, inputs


def test_readings(spark):
    reads, ranks, rules, inputs = made_reads(spark)
    last = {(r.side, r["mode"]): r for r in readings.snapshot(reads).collect()}
    assert len(last) == 4 and all(0 <= r.reading <= 1 and r.denominator == 6 and r.dropped == [] for r in last.values())
    rate = reads.filter("mode = 'replica' and side = 'sell'").agg(F.sum("fired_count") / F.sum("denominator")).first()[0]
    assert 0.06 < rate < 0.15
    one_gone, *_ = made_reads(spark, gone=2)
    last = readings.snapshot(one_gone).filter("side = 'sell'").collect()
    assert all(r.denominator == 5 and r.dropped == ["in2"] for r in last)
    with pytest.raises(ValueError):
        readings.input_grid(ranks, rules, inputs.unionByName(inputs))
    with pytest.raises(ValueError):
        triggers.checked_rules(rules.withColumn("pct", F.lit(100.0)))
    heavy = readings.readings(readings.input_grid(ranks, rules, inputs), spark.createDataFrame([("c0", 9.0)], "cluster string, weight double"))
    assert heavy.filter("mode = 'improved'").agg(F.sum("reading")).first()[0] != reads.filter("mode = 'improved'").agg(F.sum("reading")).first()[0]


def test_partitions_do_not_change_results(spark):
    reads, *_ = made_reads(spark, 200)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(str, made_reads(spark, 200)[0].collect())))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert out[0] == out[1]


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.2, 0.59, 0.6, 0.8, 1.0, -0.1, None)], "r double")
    assert [r[0] for r in df.select(readings.band(F.col("r"))).collect()] == ["No signal", "Mild", "Moderate", "Strong", "Extreme", "Extreme", "Extreme", None]
    reads, *_ = made_reads(spark)
    t = {r.band: r.threshold for r in readings.calibrated(reads).filter("side = 'sell' and mode = 'improved'").collect()}
    assert t["Mild"] <= t["Moderate"] <= t["Strong"] <= t["Extreme"]
    a, b = ([r.thresholds for r in readings.walk_forward(reads, 50, x).orderBy("side", "mode", "date").collect()] for x in (True, False))
    for x, y in zip(a, b):
        assert (x is None) == (y is None) and (x is None or np.allclose(x, y))
    at = ["side", "mode", "quantile"]
    ci = evaluation.bootstrap_bands(reads, 60).orderBy(at).collect()
    assert len(ci) == 16 and all(r.lo <= r.hi for r in ci)
    for other in (evaluation.bootstrap_bands(reads, 60, chunk=7), evaluation.bootstrap_bands(reads, 60, size=100)):
        for x, y in zip(ci, other.orderBy(at).collect(), strict=True):
            assert x[:4] == y[:4] and np.allclose(x[4:], y[4:])


def test_evaluation_against_plain_numpy(spark):
    rng = np.random.default_rng(13)
    p, h = walk(600, 13), 10
    fwd = p[h:] / p[:-h] - 1
    sig = np.where(fwd < np.quantile(fwd, 0.2), True, rng.random(len(fwd)) < 0.05)
    signals = spark.createDataFrame([("e", side, day(i), bool(s)) for side in ("sell", "buy") for i, s in enumerate(sig)], "entity_id string, side string, date date, sig boolean")
    rows = evaluation.paired(evaluation.forward_returns(series(spark, p=p), [h]), signals)
    out = {r.side: r for r in evaluation.evaluate(rows).collect()}
    hit = fwd < 0
    assert out["sell"].base_rate == pytest.approx(hit.mean()) and out["sell"].lift == pytest.approx(hit[sig].mean() - hit.mean()) and out["sell"].lift > 0.15
    from ebbmark.functions.helpers import newey_west

    beta, se = newey_west(fwd, np.column_stack([np.ones(len(fwd)), sig]).astype(float), h - 1)
    assert out["sell"].return_difference == pytest.approx(beta[1]) and out["sell"].t_stat == pytest.approx(beta[1] / se[1])
    d = [fwd[k::h][sig[k::h]].mean() - fwd[k::h][~sig[k::h]].mean() for k in range(h)]
    apart = {r.side: r for r in evaluation.non_overlapping(rows).collect()}["sell"]
    assert apart.difference == pytest.approx(np.mean(d)) and apart.dispersion == pytest.approx(np.std(d)) and apart.offsets_used == h
    ci = {r.side: r for r in evaluation.bootstrap_lift(rows, 60).collect()}["sell"]
    assert ci.lift_lo < out["sell"].lift < ci.lift_hi
    banded = evaluation.evaluate_by_band(rows.withColumn("band", F.when(F.col("sig"), "hi").otherwise("lo"))).filter("side = 'sell'").collect()
    assert sum(r.share_of_time for r in banded) == pytest.approx(1) and len({r.base_rate for r in banded}) == 1
    few = evaluation.mean_difference(rows.limit(20)).first()
    assert few is None or few.difference is None


def test_independent_reference_and_redundancy(spark):
    reads, *_ = made_reads(spark, same=True)
    sell = reads.filter("side = 'sell' and mode = 'replica'")
    rates = sell.groupBy("entity_id", "side", "mode").agg((F.sum("fired_count") / F.sum("denominator")).alias("fire_prob"))
    ref = evaluation.binomial_quantiles(rates, 6, [0.95]).filter("k = 6").first().reference
    assert ref * 6 == pytest.approx(round(ref * 6))
    assert evaluation.redundancy(sell, rates, 6).first().effective_k < 6


def test_as_of(spark):
    obs = spark.createDataFrame([("e", "w", day(0), day(3), 1.0), ("e", "w", day(7), day(10), 2.0), ("e", "w", day(8), day(10), None)], schemas.STORED_OBS)
    cal = spark.createDataFrame([("e", "w", day(i)) for i in range(40)], "entity_id string, series_id string, date date")
    got = values(alignment.as_of(obs, cal, 21))
    assert got == [None] * 3 + [1.0] * 7 + [2.0] * 22 + [None] * 8
    assert alignment.business_days(spark.createDataFrame([(day(0), day(13))], "lo date, hi date")).count() == 10


def test_reconciliation(spark):
    truth = spark.createDataFrame([("a", day(0), 100.0, True), ("b", day(0), 100.0, True), ("c", day(0), 0.0, True), ("d", day(0), 5.0, True), ("e", day(0), 5.0, True), ("neg", day(0), -27258.0, False)], "role string, as_of date, expected double, must_match boolean")
    found = spark.createDataFrame([("a", day(0), 100.009), ("b", day(0), 101.0), ("c", day(0), 0.5), ("d", day(1), 5.0), ("neg", day(0), -6948.0)], "role string, as_of date, actual double")
    done = alignment.reconciled(truth, found)
    assert [r.result for r in done.orderBy("role").collect()] == ["match", "mismatch", "match", "date_mismatch", "missing", "mismatch"]
    assert done.filter("role = 'neg'").first().passed
    assert {r.result: r.n for r in alignment.reconciliation_summary(done).collect()}["match"] == 2


def test_positioning(spark):
    raw = spark.createDataFrame([("2020-01-07T00:00:00", "1", "GOLD - X", "0", "5", "3", "1", "1"), ("2020-01-14", "1", "old name", "100", "5", "x", "1", "1"), ("2020-01-14", "2", "SILVER", "10", "1", "2", "1", "1"), (None, "1", "GOLD", "1", "1", "1", "1", "1")], schemas.POSITIONS_RAW)
    contracts = spark.createDataFrame([("1", "gold", "gold", 1, False, True), ("2", "copper", "COPPER", 1, False, True)], schemas.CONTRACTS)
    rows = positioning.typed(raw)
    assert [r.code for r in positioning.mismatched_contracts(rows, contracts).collect()] == ["2"]
    out = {(r.code, r.date): r for r in positioning.derived(rows, contracts).collect()}
    first = out[("1", datetime.date(2020, 1, 7))]
    assert first.net == 2 and first.net_pct_oi is None and first.knowable_from == datetime.date(2020, 1, 10)
    assert out[("1", datetime.date(2020, 1, 14))].net is None and len(out) == 3
    store = positioning.derived(rows, contracts)
    again = store.withColumn("net", F.lit(9.0)).withColumn("seq", F.lit(1)).unionByName(store.withColumn("net", F.lit(7.0)).withColumn("seq", F.lit(0)))
    merged = positioning.upserted(store, again, "seq")
    assert merged.count() == 3 and {r.net for r in merged.collect()} == {9.0}
    assert positioning.newer(store, positioning.last_dates(store)).count() == 0
    summary = {r.alias: r for r in positioning.run_summary(store, store, contracts.unionByName(spark.createDataFrame([("3", "tin", "TIN", 1, False, False)], schemas.CONTRACTS)), datetime.date(2020, 3, 1)).collect()}
    assert summary["tin"].status == "no rows" and summary["gold"].late and summary["gold"].rows == 2


def test_status_order_and_resolution(spark):
    rows = [("a", 10, 0, 5.0), ("b", None, None, None), ("c", None, None, None), ("d", 10, 30, 5.0), ("e", 10, 0, 0.5), ("f", 10, 0, 5.0)]
    cand = spark.createDataFrame([(t, "PX", "weekly", p, s, y) for t, p, s, y in rows], "ticker string, field string, frequency string, points int, staleness_days int, history_years double")
    errors = spark.createDataFrame([("a", "PX", "security", "BAD"), ("b", "PX", "field", "NO_AUTH"), ("f", "PX", "field", "NO_AUTH")], "ticker string, field string, kind string, category string")
    assert [r.status for r in series_quality.status(cand, errors, 1.0).orderBy("ticker").collect()] == ["INVALID_TICKER", "FIELD_DENIED", "NO_DATA", "STALE", "OK_SHORT_HISTORY", "OK"]
    roles = spark.createDataFrame([("i", "r", False, "x", 0, "STALE"), ("i", "r", False, "y", 1, "OK"), ("i", "b", True, "z", 0, "OK"), ("j", "r", False, "q", 0, "NO_DATA")], "input_id string, role string, basket boolean, candidate string, position int, status string")
    got = {(r.input_id, r.role): (r.tickers, r.satisfied) for r in series_quality.resolved(roles).collect()}
    assert got == {("i", "r"): (["y"], True), ("i", "b"): (["z"], False), ("j", "r"): ([], False)}
    assert {r.input_id: r.verdict for r in series_quality.verdicts(series_quality.resolved(roles)).collect()} == {"i": "PARTIAL", "j": "BLOCKED"}
