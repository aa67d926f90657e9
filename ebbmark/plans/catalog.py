"""Registered queries of the signal library over the driver's tables, each with its DuckDB SQL.

Outputs are rounded to six decimals and counts are bigint on both sides.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbmark.core.tables import shared_dir, small, table
from ebbmark.core.windows import KEY, year_rows
from ebbmark.functions import transforms as T
from ebbmark.operators import alignment, evaluation, positioning, readings, regression, series_quality, triggers
from ebbmark.plans import domain as D
from ebbmark.sources import readers, sinks
from ebbmark.streaming.refresh import read_refreshed, refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TODAY = datetime.date(2024, 2, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six decimals, integers as bigint, string arrays comma-joined."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        out.append((F.round(c, 6) if kind == "double" else c.cast("long") if kind in ("int", "bigint") else F.array_join(c, ",") if kind == "array<string>" else c).alias(f.name))
    return df.select(*out)


OBS3 = "entity_id, series_id, date"


def series_sql(needs: tuple[str, ...], body: str, key: str = OBS3, value: str = "value") -> str:
    return D.sql(*needs) + f"select {key}, round({value}, 6) as value from {body}"


# --- ranks and triggers


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.causal_rank(D.obs(spark, sf_dir), min_periods=D.MIN_PERIODS).withColumnRenamed("series_id", "input_id")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.input_grid(table(_ranks(spark, sf_dir), "ranks"), D.rules(spark), D.inputs(spark))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.readings(_grid(spark, sf_dir))


@query(D.sql("ranks") + "select entity_id, input_id, date, round(rank, 6) as rank from ranks")
def rank_expanding(spark, sf_dir):
    return tidy(_ranks(spark, sf_dir))


@query(
    D.sql("nn")
    + "select a.entity_id, a.series_id, a.date, case when least(a.rn, 100) >= 60 then round(count(*) filter (where b.value <= a.value) / least(a.rn, 100)::double, 6) end as rank from nn a join nn b on a.entity_id = b.entity_id and a.series_id = b.series_id and b.rn between a.rn - 99 and a.rn group by a.entity_id, a.series_id, a.date, a.rn"
)
def rank_rolling(spark, sf_dir):
    return tidy(triggers.causal_rank(D.obs(spark, sf_dir), 100, 60))


@query(D.sql("grid") + "select entity_id, side, date, input_id, cluster, round(rank, 6) as rank, round(hinge, 6) as hinge, fired from grid")
def trigger_grid(spark, sf_dir):
    return tidy(_grid(spark, sf_dir))


@query(D.sql("rules") + "select side, count(*)::bigint as n_inputs from rules group by side")
def published_denominator(spark, sf_dir):
    used = D.obs(spark, sf_dir).select("series_id").distinct()
    return triggers.published_denominator(triggers.checked_rules(D.rules(spark)).join(small(used), F.col("input_id") == F.col("series_id"), "left_semi"))


@query(SQL["rank_expanding"])
def rank_expanding_blocks(spark, sf_dir):
    """rank_expanding with every series cut into blocks of 400 rows."""
    ranks = triggers.causal_rank(D.obs(spark, sf_dir), min_periods=D.MIN_PERIODS, size=400)
    return tidy(ranks.withColumnRenamed("series_id", "input_id"))


@query(SQL["rank_rolling"])
def rank_rolling_blocks(spark, sf_dir):
    return tidy(triggers.causal_rank(D.obs(spark, sf_dir), 100, 60, size=400))


@query(
    D.sql("nn")
    + "select a.entity_id, a.series_id, a.date, years::bigint as years, case when least(a.rn, 252 * years) >= 60 then round(count(*) filter (where b.value <= a.value and b.rn > a.rn - 252 * years) / least(a.rn, 252 * years)::double, 6) end as rank from nn a join nn b on a.entity_id = b.entity_id and a.series_id = b.series_id and b.rn between a.rn - 1259 and a.rn cross join (values (1), (3), (5)) t(years) group by a.entity_id, a.series_id, a.date, a.rn, years"
)
def rank_years(spark, sf_dir):
    """Ranks over windows given in years."""
    o = D.obs(spark, sf_dir)
    one, three, five = (triggers.causal_rank(o, year_rows(y), D.MIN_PERIODS).withColumn("years", F.lit(y)) for y in (1, 3, 5))
    return tidy(one.unionByName(three).unionByName(five))


# --- readings


_BAND = "case when reading is null then null when reading >= 0 and reading < 0.2 then 'No signal' when reading >= 0.2 and reading < 0.4 then 'Mild' when reading >= 0.4 and reading < 0.6 then 'Moderate' when reading >= 0.6 and reading < 0.8 then 'Strong' else 'Extreme' end as band"


@query(D.sql("reads") + f"select entity_id, date, round(reading, 6) as reading, denominator, {_BAND} from reads where side = 'sell' and mode = 'improved'")
def reading_improved_sell(spark, sf_dir):
    out = _reads(spark, sf_dir).filter("side = 'sell' and mode = 'improved'")
    return tidy(out.select("entity_id", "date", "reading", "denominator", readings.band(F.col("reading")).alias("band")))


@query(D.sql("reads") + "select entity_id, side, mode, date, round(reading, 6) as reading, denominator, fired_count, array_to_string(dropped, ',') as dropped from reads")
def readings_all(spark, sf_dir):
    return tidy(_reads(spark, sf_dir))


@query(
    D.sql("reads")
    + f"select entity_id, side, mode, date, round(reading, 6) as reading, denominator, fired_count, array_to_string(dropped, ',') as dropped, {_BAND} from reads qualify row_number() over (partition by entity_id, side, mode order by date desc) = 1"
)
def snapshot_latest(spark, sf_dir):
    return tidy(readings.snapshot(_reads(spark, sf_dir)))


@query(
    D.sql("reads")
    + "select entity_id, side, mode, band, round(quantile_cont(reading, q), 6) as threshold from reads cross join (values ('Mild', 0.70), ('Moderate', 0.85), ('Strong', 0.95), ('Extreme', 0.99)) t(band, q) group by entity_id, side, mode, band, q".replace("quantile_cont(reading, q)", "case band when 'Mild' then quantile_cont(reading, 0.70) when 'Moderate' then quantile_cont(reading, 0.85) when 'Strong' then quantile_cont(reading, 0.95) else quantile_cont(reading, 0.99) end")
)
def bands_calibrated(spark, sf_dir):
    return tidy(readings.calibrated(_reads(spark, sf_dir)))


_FORWARD = ", ".join(f"case when count(reading) over w >= 100 then round(quantile_cont(reading, {q}) over w, 6) end as {n.lower()}" for n, q in readings.QUANTILES)


@query(D.sql("reads") + f"select entity_id, side, mode, date, {_FORWARD} from reads window w as (partition by entity_id, side, mode order by date rows unbounded preceding)")
def bands_walk_forward(spark, sf_dir):
    return _walked(readings.walk_forward(_reads(spark, sf_dir), 100))


@query(SQL["bands_walk_forward"])
def bands_walk_forward_blocks(spark, sf_dir):
    """The same with every reading's history cut into blocks of 500 rows."""
    return _walked(readings.walk_forward(table(_reads(spark, sf_dir), "reads"), 100, size=500))


def _walked(out: DataFrame) -> DataFrame:
    return tidy(out.select("entity_id", "side", "mode", "date", *(F.get("thresholds", F.lit(i)).alias(n.lower()) for i, (n, _) in enumerate(readings.QUANTILES))))


def _bootstrap_sql(boots: int) -> str:
    """ci(entity_id, side, mode, quantile, lo, hi) from the same draws, whose rows are joined one by one."""
    return D.sql("reads") + f""", rr as materialized (select entity_id, side, mode, reading, row_number() over (partition by entity_id, side, mode order by date) - 1 as pos, count(*) over (partition by entity_id, side, mode) as n from reads where reading is not null),
draws as (select *, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2 from (select *, md5('0|' || entity_id || '|' || side || '|' || mode || '|' || rep || '|' || j) as h from
 (select *, unnest(range(0, last + 1)) as j from (select distinct entity_id, side, mode, n, ceil(2 * n / 21.0)::bigint + 19 as last, unnest(range(0, {boots})) as rep from rr where n >= 100)))),
lens as (select *, floor(h1 * n / 4294967296.0)::bigint as start, case when j = last then n else least(n, 1 + floor(ln((h2 + 0.5) / 4294967296.0) / ln(1 - 1 / 21.0))::bigint) end as len from draws),
laid as (select *, coalesce(sum(len) over (partition by entity_id, side, mode, rep order by j rows between unbounded preceding and 1 preceding), 0)::bigint as before from lens),
places as (select entity_id, side, mode, rep, n, unnest(range(start, start + least(len, n - before))) % n as pos from laid where before < n),
qs as (select entity_id, side, mode, rep, quantile_cont(reading, [0.70, 0.85, 0.95, 0.99]) as q from places join rr using (entity_id, side, mode, pos) group by 1, 2, 3, 4),
ci as materialized (select entity_id, side, mode, quantile, quantile_cont(v, 0.025) as lo, quantile_cont(v, 0.975) as hi from (select entity_id, side, mode, unnest([0.70, 0.85, 0.95, 0.99]) as quantile, unnest(q) as v from qs) group by 1, 2, 3, 4)
"""


_BAND_AT = "case quantile when 0.70 then quantile_cont(reading, 0.70) when 0.85 then quantile_cont(reading, 0.85) when 0.95 then quantile_cont(reading, 0.95) else quantile_cont(reading, 0.99) end"
_CI = "round(lo, 6) as lo, round(hi, 6) as hi, round(hi - lo, 6) as width"


@query(
    _bootstrap_sql(500)
    + f"select entity_id, side, mode, case quantile when 0.70 then 'Mild' when 0.85 then 'Moderate' when 0.95 then 'Strong' else 'Extreme' end as band, quantile::double as quantile, threshold, {_CI} from ci join (select entity_id, side, mode, quantile, round({_BAND_AT}, 6) as threshold from reads cross join (values (0.70), (0.85), (0.95), (0.99)) t(quantile) group by 1, 2, 3, 4) using (entity_id, side, mode, quantile)"
)
def bands_bootstrap(spark, sf_dir):
    return tidy(evaluation.bootstrap_bands(table(_reads(spark, sf_dir), "reads")))


@query(series_sql(("obs",), "(select entity_id, series_id, date, case when not (series_id = '1-URGENT' and (year(date) = 1997 or year(date) between 1999 and 2000)) then value end as value from obs)"))
def crisis_filter(spark, sf_dir):
    periods = spark.createDataFrame([("1-URGENT", 1997, 1997), ("1-URGENT", 1999, 2000)], "series_id string, lo int, hi int")
    return tidy(readings.without_periods(D.obs(spark, sf_dir), periods)).select(*KEY, "date", "value")


@query(
    D.sql("grid", "prices")
    + "select entity_id, side, date, input_id, case when fired is null then null when side <> 'sell' then fired else fired and coalesce(open, false) end as fired from grid left join (select entity_id, date, case when count(value) over w >= 200 then value < avg(value) over w end as open from prices window w as (partition by entity_id order by date rows 199 preceding)) using (entity_id, date)"
)
def trend_gate(spark, sf_dir):
    return readings.trend_gate(_grid(spark, sf_dir).select("entity_id", "side", "date", "input_id", "fired"), D.prices(spark, sf_dir)).select("entity_id", "side", "date", "input_id", "fired")


@query(
    D.sql("obs")
    + "select a.entity_id, a.series_id as id_a, b.series_id as id_b, round(corr(a.value, b.value), 6) as corr from obs a join obs b on a.entity_id = b.entity_id and a.date = b.date and a.series_id < b.series_id where a.value is not null and b.value is not null group by all having corr(a.value, b.value) >= -0.5"
)
def correlated_inputs(spark, sf_dir):
    return tidy(readings.correlated(D.obs(spark, sf_dir), -0.5))


@query(
    D.sql("obs")
    + """, pairs as (select a.entity_id, a.series_id as x, b.series_id as y from obs a join obs b on a.entity_id = b.entity_id and a.date = b.date and a.series_id <> b.series_id where a.value is not null and b.value is not null group by all having corr(a.value, b.value) >= 0.02),
walk as (with recursive r as (select distinct entity_id, series_id, series_id as label from obs union select r.entity_id, p.y, r.label from r join pairs p on p.entity_id = r.entity_id and p.x = r.series_id) select * from r)
select entity_id, series_id, min(label) as cluster from walk group by 1, 2"""
)
def correlated_clusters(spark, sf_dir):
    o = D.obs(spark, sf_dir)
    return readings.correlated_clusters(o.select("entity_id", "series_id").distinct(), readings.correlated(o, 0.02))


# --- transforms


def _t(name: str, sql: str, f: Callable[[DataFrame], DataFrame], source=D.obs) -> None:
    QUERIES[name] = lambda spark, sf_dir: tidy(f(source(spark, sf_dir)))
    if sql:
        SQL[name] = sql


_t("t1_diff_horizon", series_sql(("obs",), f"(select {OBS3}, value - lag(value, 63) over ({D.W}) as value from obs)"), lambda o: T.diff_horizon(o, 3))
_t("t2_smooth", series_sql(("obs",), f"(select {OBS3}, case when count(value) over w >= 10 then avg(value) over w end as value from obs window w as ({D.W} rows 20 preceding))"), lambda o: T.smooth(o, 1))
_t("t3_robust_z_rolling", series_sql(("zlegs",), "zlegs", value="z"), lambda o: T.robust_z(o, 252), D.legs)
_EXP_Z = f"(select *, case when mad <> 0 and value is not null then greatest(-3, least(3, (value - med) / (1.4826 * mad))) end as z from (select *, case when count(dev) over w >= 30 then quantile_cont(dev, 0.5) over w end as mad from (select *, abs(value - med) as dev from (select *, case when count(value) over w >= 30 then quantile_cont(value, 0.5) over w end as med from obs window w as ({D.W} rows unbounded preceding))) window w as ({D.W} rows unbounded preceding)))"
_t("t3_robust_z_expanding", series_sql(("obs",), _EXP_Z, value="z"), lambda o: T.robust_z(o, long_series=True))
_t("t5_rsi", series_sql(("rsi",), "rsi"), T.rsi)
_t("t6_realised_vol", series_sql(("vol",), "vol", value="vol"), T.realised_vol)
_t("t7_vol_target", series_sql(("vol",), "vol", value="case when vol <> 0 then least(0.1 / vol, 3) end"), T.vol_target_weight)
_t("t8_inverse_vol", series_sql(("vol",), "vol", value="(1 / nullif(vol, 0)) / sum(1 / nullif(vol, 0)) over (partition by entity_id, date)"), T.inverse_vol_weights)
_t("t12_returns", series_sql(("ret",), "ret", value="r"), T.returns)
_t(
    "t11_trend",
    series_sql(
        ("vol",),
        "(select *, list_avg(list_filter([s1, s2, s3], lambda x: x is not null)) as m from (select *, "
        + ", ".join(f"sign(value / nullif(lag(value, {n}) over ({D.W}), 0) - 1) * case when vol <> 0 then least(abs(value / nullif(lag(value, {n}) over ({D.W}), 0) - 1) / vol, 2) + 0 * (value / lag(value, {n}) over ({D.W})) end as s{i}" for i, n in ((1, 21), (2, 63), (3, 252)))
        + " from vol))",
        value="m",
    ),
    T.trend_replication,
)
_t("t14_basket_rsi", D.sql("rsi") + "select entity_id, 'rsi' as series_id, date, round(avg(value), 6) as value from rsi group by all", lambda o: T.basket_mean(T.rsi(o), "rsi"))
# totals of cents over small weights often lie half-way at the sixth decimal: 1e-9 rounds these alike on both sides
_t("t15_weighted_basket", D.sql("legs") + "select entity_id, 'basket' as series_id, date, round(sum(value * weight) / sum(weight) + 1e-9, 6) as value from legs group by all", lambda o: T.weighted_basket(o.drop("weight"), o.select(*KEY, "date", "weight"), "basket").withColumn("value", F.col("value") + 1e-9), D.legs)
_t("t_basket_sum", D.sql("obs") + "select entity_id, 'sum' as series_id, date, round(sum(value), 6) as value from obs group by all", lambda o: T.basket_sum(o, "sum"))
_t(
    "t16_chain",
    series_sql(("rsi",), f"(select {OBS3}, value - lag(value, 63) over ({D.W}) as value from (select {OBS3}, case when count(value) over w >= 10 then avg(value) over w end as value from rsi window w as ({D.W} rows 20 preceding)))"),
    lambda o: T.chain(o, "rsi", smooth_months=1, diff_months=3),
)


@query(D.sql("zlegs") + "select entity_id, date, round(avg(case when series_id = 'R' then -z else z end), 6) as value from zlegs group by all")
def t9_mean_of_z(spark, sf_dir):
    directions = spark.createDataFrame([("A", False), ("N", False), ("R", True)], "series_id string, invert boolean")
    return tidy(T.mean_of_z(D.legs(spark, sf_dir), directions, 252))


@query(
    D.sql("ret", "prices")
    + f"select o.entity_id, o.series_id, o.date, round(b.beta, 6) as value from obs o left join (select entity_id, series_id, date, case when count(*) over w >= 20 then regr_slope(ry, rx) over w end as beta from (select r.entity_id, r.series_id, r.date, r.r as ry, p.rx from ret r join (select entity_id, date, value / lag(value) over ({D.W}) - 1 as rx from prices) p using (entity_id, date) where r.r is not null and p.rx is not null) window w as ({D.W} rows 19 preceding)) b using (entity_id, series_id, date)"
)
def t4_rolling_beta(spark, sf_dir):
    return tidy(T.rolling_beta(D.obs(spark, sf_dir), D.prices(spark, sf_dir), 20))


@query()
def t10_first_component(spark, sf_dir):
    return tidy(T.first_principal_component(D.obs(spark, sf_dir), list(D.PRIORITIES), 60))


_PAIR = f"""p as (select entity_id, date, max(r) filter (where series_id = '{D.PRIORITIES[0]}') as x, max(r) filter (where series_id = '{D.PRIORITIES[1]}') as y from ret group by 1, 2),
c as (select entity_id, date, case when y is not null then x end as x, case when x is not null then y end as y from p),
s as (select entity_id, date, count(x) over w as n, avg(x) over w as mx, avg(y) over w as my, stddev_samp(x) over w as sx, stddev_samp(y) over w as sy, corr(x, y) over w as r, last_value(x ignore nulls) over w as lx, last_value(y ignore nulls) over w as ly, row_number() over (partition by entity_id order by date) as i
 from c window w as (partition by entity_id order by date rows between 60 preceding and 1 preceding))
select entity_id, date, case when i > 60 and n >= 30 and sx > 0 and sy > 0 then round(((lx - mx) / sx + sign(r) * (ly - my) / sy) / sqrt(2.0), 6) end as value from s"""


@query(D.sql("ret").rstrip() + ", " + _PAIR)
def t10_two_series(spark, sf_dir):
    """The first component of two series, whose loadings are equal but for the sign of their correlation."""
    return tidy(T.first_principal_component(D.obs(spark, sf_dir), list(D.PRIORITIES[:2]), 60))


@query(D.sql("obs") + "select entity_id, 'ratio' as series_id, date, round(a.value / nullif(b.value, 0), 6) as value from obs a join obs b using (entity_id, date) where a.series_id = '1-URGENT' and b.series_id = '5-LOW'")
def t13_ratio(spark, sf_dir):
    o = D.obs(spark, sf_dir)
    return tidy(T.ratio_of(o.filter("series_id = '1-URGENT'"), o.filter("series_id = '5-LOW'"), "ratio"))


# --- evaluation


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _reads(spark, sf_dir).filter("mode = 'replica'")
    return reads.select("entity_id", "side", "date", (F.col("reading") >= 0.2).alias("sig"), "reading")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(evaluation.paired(evaluation.forward_returns(D.prices(spark, sf_dir), [5, 21]), _signals(spark, sf_dir)), "pairs")


@query(D.sql("fwd") + "select entity_id, 'total' as series_id, date, horizon::bigint as horizon, round(fwd, 6) as fwd from fwd")
def e1_forward_returns(spark, sf_dir):
    return tidy(evaluation.forward_returns(D.prices(spark, sf_dir), [5, 21]))


@query(D.sql("md") + "select entity_id, side, horizon::bigint as horizon, round(difference, 6) as difference, round(se, 6) as se, round(t_stat, 6) as t_stat, n, n_signal, round(n_effective, 6) as n_effective, lags::bigint as lags from md")
def e4_mean_difference(spark, sf_dir):
    return tidy(evaluation.mean_difference(_pairs(spark, sf_dir)))


@query(SQL["e4_mean_difference"])
def e4_mean_difference_blocks(spark, sf_dir):
    """The same with running totals as scans of blocks of 300 rows."""
    return tidy(evaluation.mean_difference(_pairs(spark, sf_dir), size=300))


@query(D.sql("apart") + "select entity_id, side, horizon::bigint as horizon, round(difference, 6) as difference, round(dispersion, 6) as dispersion, round(n_blocks, 6) as n_blocks, offsets_used from apart")
def e5_non_overlapping(spark, sf_dir):
    return tidy(evaluation.non_overlapping(_pairs(spark, sf_dir)))


_RATES = """select p.entity_id, p.side, p.horizon::bigint as horizon, round(base_rate, 6) as base_rate, round(conditional_rate, 6) as conditional_rate, round(mean_return_all, 6) as mean_return_all,
 round(mean_return_signal, 6) as mean_return_signal, round(m.difference, 6) as return_difference, round(t_stat, 6) as t_stat, n, n_signal, round(n_effective, 6) as n_effective,
 round(a.difference, 6) as non_overlapping_difference, round(conditional_rate - base_rate, 6) as lift, round(conditional_rate / nullif(base_rate, 0), 6) as lift_ratio
 from (select entity_id, side, horizon, avg(hit) as base_rate, avg(hit) filter (where sig) as conditional_rate, avg(fwd) as mean_return_all, avg(fwd) filter (where sig) as mean_return_signal from pairs group by all) p
 join md m using (entity_id, side, horizon) join apart a using (entity_id, side, horizon)"""


@query(D.sql("md", "apart") + _RATES)
def e6_evaluate(spark, sf_dir):
    return tidy(evaluation.evaluate(_pairs(spark, sf_dir)))


@query(
    D.sql("pairs")
    + f"select b.entity_id, b.side, b.horizon::bigint as horizon, b.band, b.n, round(b.n / b.horizon::double, 6) as n_effective, round(b.n / t.total::double, 6) as share_of_time, round(base_rate, 6) as base_rate, round(conditional_rate, 6) as conditional_rate, round(conditional_rate - base_rate, 6) as lift, round(mean_return, 6) as mean_return, round(mean_return_all, 6) as mean_return_all, round(mean_return - mean_return_all, 6) as return_difference, b.n / b.horizon::double < 10 as thin from (select entity_id, side, horizon, {_BAND}, count(*) as n, avg(hit) as conditional_rate, avg(fwd) as mean_return from pairs group by all) b join (select entity_id, side, horizon, count(*) as total, avg(hit) as base_rate, avg(fwd) as mean_return_all from pairs group by all) t using (entity_id, side, horizon)"
)
def e7_by_band(spark, sf_dir):
    return tidy(evaluation.evaluate_by_band(_pairs(spark, sf_dir).withColumn("band", readings.band(F.col("reading")))))


@query(D.sql("lifts", "groups") + "select entity_id, side, horizon::bigint as horizon, round(lift_lo, 6) as lift_lo, round(lift_hi, 6) as lift_hi from groups left join lifts using (entity_id, side, horizon)")
def e9_bootstrap_lift(spark, sf_dir):
    return tidy(evaluation.bootstrap_lift(_pairs(spark, sf_dir)))


def _rates(reads: DataFrame) -> DataFrame:
    return reads.filter("mode = 'replica'").groupBy("entity_id", "side", "mode").agg((F.sum("fired_count") / F.sum("denominator")).alias("fire_prob"))


_Q = "(values (0.7), (0.85), (0.95), (0.99)) t(quantile)"


@query(D.sql("binomial") + f"select entity_id, side, mode, k::bigint as k, quantile::double as quantile, round(min(j) filter (where cdf >= quantile - 1e-12) / k::double, 6) as reference from binomial cross join {_Q} group by entity_id, side, mode, k, quantile")
def e10_binomial_reference(spark, sf_dir):
    return tidy(evaluation.binomial_quantiles(_rates(_reads(spark, sf_dir)), 8, [0.7, 0.85, 0.95, 0.99]))


@query(
    D.sql("binomial", "one")
    + "select entity_id, side, 'replica' as mode, round(observed, 6) as observed_quantile, 5::bigint as nominal_k, k::bigint as effective_k, round(k / 5.0, 6) as ratio from (select entity_id, side, k, min(j) filter (where cdf >= 0.95 - 1e-12) / k::double as reference from binomial where k <= 5 group by entity_id, side, k)"
    " join (select entity_id, side, quantile_cont(replica, 0.95) as observed from one group by all) using (entity_id, side) qualify row_number() over (partition by entity_id, side order by abs(reference - observed), k) = 1"
)
def e11_redundancy(spark, sf_dir):
    reads = table(_reads(spark, sf_dir), "reads")
    return tidy(evaluation.redundancy(reads.filter("mode = 'replica'"), _rates(reads), 5))


_PUBLISHED = "(values ('Mild', 0.20, 0.70), ('Moderate', 0.30, 0.85), ('Strong', 0.40, 0.95), ('Extreme', 0.50, 0.99)) t(band, published, quantile)"
_AT = "case band when 'Mild' then quantile_cont(reading, 0.70) when 'Moderate' then quantile_cont(reading, 0.85) when 'Strong' then quantile_cont(reading, 0.95) else quantile_cont(reading, 0.99) end"


@query(D.sql("reads") + f"select entity_id, side, mode, band, published::double as published, round({_AT}, 6) as threshold, round(count(*) filter (where reading >= published) / count(reading)::double, 6) as share_above from reads cross join {_PUBLISHED} group by entity_id, side, mode, band, published")
def e12_thresholds(spark, sf_dir):
    """The thresholds that come with a full evaluation: published, calibrated, and how often readings pass the former."""
    return tidy(evaluation.thresholds(table(_reads(spark, sf_dir), "reads")))


@query(
    _bootstrap_sql(300)
    + f"select t.*, {_CI} from ({SQL['e12_thresholds'][len(D.sql('reads')):]}) t join (values ('Mild', 0.70), ('Moderate', 0.85), ('Strong', 0.95), ('Extreme', 0.99)) b(band, quantile) using (band) left join ci using (entity_id, side, mode, quantile)"
)
def e12_bands(spark, sf_dir):
    """The same with the bootstrap interval of each calibrated threshold."""
    return tidy(evaluation.thresholds(table(_reads(spark, sf_dir), "reads"), n_boot=300))


@query(D.sql("md", "apart", "lifts", boots=300, horizons=(21, 63, 126)) + _RATES.replace("as lift_ratio", "as lift_ratio, round(lift_lo, 6) as lift_lo, round(lift_hi, 6) as lift_hi") + " left join lifts using (entity_id, side, horizon)")
def e12_full_evaluation(spark, sf_dir):
    return tidy(evaluation.full_evaluation(D.prices(spark, sf_dir), _signals(spark, sf_dir)))


_E3 = """, x as materialized (select entity_id, f.date, fwd as y, value as x, row_number() over (partition by entity_id order by f.date) as rn
 from (select entity_id, date, lead(value, 21) over (partition by entity_id order by date) / nullif(value, 0) - 1 as fwd from prices) f join (select entity_id, date, avg(value) as value from rsi group by all) r using (entity_id, date) where fwd is not null and value is not null),
b as (select entity_id, count(*) as n, sum(x) as sx, sum(x * x) as sxx, count(*) * sum(x * x) - sum(x) * sum(x) as det, regr_slope(y, x) as b1, regr_intercept(y, x) as b0 from x group by 1),
u as materialized (select entity_id, rn, y - b0 - b1 * x as u0, (y - b0 - b1 * x) * x as u1 from x join b using (entity_id)),
m as (select p.entity_id, sum(w * p.u0 * q.u0) as m00, sum(w * (p.u0 * q.u1 + q.u0 * p.u1) / 2) as m01, sum(w * p.u1 * q.u1) as m11
 from (select p.*, unnest(range(0, 21)) as l from u p) p join u q on q.entity_id = p.entity_id and q.rn = p.rn - p.l cross join lateral (select case when p.l = 0 then 1.0 else 2 * (1 - p.l / 21.0) end as w) group by 1)
select entity_id, term::bigint as term, round(case when term = 0 then b0 else b1 end, 6) as beta,
 round(sqrt(case when term = 0 then sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11 else sx * sx * m00 - 2 * sx * n * m01 + n * n * m11 end) / det, 6) as se from b join m using (entity_id) cross join (values (0), (1)) t(term) where n > 2"""


def _returns_on(spark: SparkSession, sf_dir: str, **xs: DataFrame) -> DataFrame:
    rows = evaluation.forward_returns(D.prices(spark, sf_dir), [21]).select("entity_id", "date", "fwd")
    for name, x in xs.items():
        rows = rows.join(T.basket_mean(x, name).select("entity_id", "date", F.col("value").alias(name)), ["entity_id", "date"])
    return rows


@query(D.sql("prices", "rsi") + _E3)
def e3_newey_west(spark, sf_dir):
    return tidy(regression.newey_west(_returns_on(spark, sf_dir, rsi=T.rsi(D.obs(spark, sf_dir))), "fwd", ["rsi"], 20))


@query(SQL["e3_newey_west"])
def e3_newey_west_blocks(spark, sf_dir):
    """The same with running totals as scans of blocks of 300 rows."""
    return tidy(regression.newey_west(_returns_on(spark, sf_dir, rsi=T.rsi(D.obs(spark, sf_dir))), "fwd", ["rsi"], 20, size=300))


_E3_TWO = """, fv as (select entity_id, date, lead(value, 21) over (partition by entity_id order by date) / nullif(value, 0) - 1 as y from prices),
x as materialized (select entity_id, y, a.v as a, b.v as b, row_number() over (partition by entity_id order by date) as rn from fv join (select entity_id, date, avg(value) as v from rsi group by all) a using (entity_id, date)
 join (select entity_id, date, avg(vol) as v from vol group by all) b using (entity_id, date) where y is not null and a.v is not null and b.v is not null),
c as (select entity_id, count(*) as n, avg(y) as my, avg(a) as ma, avg(b) as mb, var_pop(a) as aa, covar_pop(a, b) as ab, var_pop(b) as bb, covar_pop(a, y) as ay, covar_pop(b, y) as by_ from x group by 1),
f as (select *, (bb * ay - ab * by_) / (aa * bb - ab * ab) as s1, (aa * by_ - ab * ay) / (aa * bb - ab * ab) as s2 from c where n > 3),
g as materialized (select entity_id, rn, u / n - ma * h1 - mb * h2 as g0, h1 as g1, h2 as g2 from
 (select *, u * (bb * (a - ma) - ab * (b - mb)) / (aa * bb - ab * ab) / n as h1, u * (aa * (b - mb) - ab * (a - ma)) / (aa * bb - ab * ab) / n as h2
 from (select *, y - my - s1 * (a - ma) - s2 * (b - mb) as u from x join f using (entity_id)))),
m as (select p.entity_id, sum(w * p.g0 * q.g0) as v0, sum(w * p.g1 * q.g1) as v1, sum(w * p.g2 * q.g2) as v2
 from (select g.*, unnest(range(0, 21)) as l from g) p join g q on q.entity_id = p.entity_id and q.rn = p.rn - p.l cross join lateral (select case when p.l = 0 then 1.0 else 2 * (1 - p.l / 21.0) end as w) group by 1)
select entity_id, term::bigint as term, round(case term when 0 then my - s1 * ma - s2 * mb when 1 then s1 else s2 end, 6) as beta, round(sqrt(greatest(case term when 0 then v0 when 1 then v1 else v2 end, 0)), 6) as se
 from f join m using (entity_id) cross join (values (0), (1), (2)) t(term)"""


@query(D.sql("prices", "rsi", "vol") + _E3_TWO)
def e3_two_regressors(spark, sf_dir):
    """Forward returns on the baskets' mean RSI and mean realised volatility."""
    o = D.obs(spark, sf_dir)
    return tidy(regression.newey_west(_returns_on(spark, sf_dir, rsi=T.rsi(o), vol=T.realised_vol(o)), "fwd", ["rsi", "vol"], 20))


# --- calendars, alignment, reconciliation


@query("select status as entity_id, date from (select o_orderstatus as status, unnest(generate_series(min(cast(o_orderdate as date)), max(cast(o_orderdate as date)), interval 1 day))::date as date from orders group by 1) where isodow(date) < 6")
def business_days(spark, sf_dir):
    spans = D.read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("entity_id")).agg(F.min(F.to_date("o_orderdate")).alias("lo"), F.max(F.to_date("o_orderdate")).alias("hi"))
    return alignment.business_days(spans)


_WEEKLY = "select 'ALL' as entity_id, code as series_id, date, knowable_from, net_pct_oi as value from positions"


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _derived(spark, sf_dir)
    return rows.select(F.lit("ALL").alias("entity_id"), F.col("code").alias("series_id"), "date", "knowable_from", F.col("net_pct_oi").alias("value"))


@query(
    D.sql("positions")
    + f", w as materialized ({_WEEKLY}), cal as materialized (select entity_id, series_id, unnest(generate_series(lo, hi, interval 1 day))::date as date from (select entity_id, series_id, min(knowable_from) as lo, max(knowable_from) + 40 as hi from w group by 1, 2)) select c.entity_id, c.series_id, c.date, case when c.date - w.knowable_from <= 21 then round(w.value, 6) end as value, case when c.date - w.knowable_from <= 21 then w.date end as as_of from (select * from cal where isodow(date) < 6) c asof left join (select * from w where value is not null) w on c.series_id = w.series_id and c.date >= w.knowable_from"
)
def as_of_align(spark, sf_dir):
    rows = _weekly(spark, sf_dir)
    spans = rows.groupBy("entity_id", "series_id").agg(F.min("knowable_from").alias("lo"), F.date_add(F.max("knowable_from"), 40).alias("hi"))
    return tidy(alignment.as_of(rows, alignment.business_days(spans), alignment.STALE_AFTER["weekly"]))


@query(SQL["as_of_align"])
def as_of_align_blocks(spark, sf_dir):
    """The same with every stream of observations and days filled in blocks of 600 rows."""
    rows = table(_weekly(spark, sf_dir), "weekly")
    spans = rows.groupBy("entity_id", "series_id").agg(F.min("knowable_from").alias("lo"), F.date_add(F.max("knowable_from"), 40).alias("hi"))
    return tidy(alignment.as_of(rows, alignment.business_days(spans), alignment.STALE_AFTER["weekly"], size=600))


_CHECKED = """t as (select o_orderkey as role, cast(o_orderdate as date) as as_of, o_totalprice as expected, o_orderstatus <> 'P' as must_match from orders),
f as (select l_orderkey as role, cast(min(l_shipdate) as date) as as_of, cast(sum(l_extendedprice::decimal(18,2)) as double) as actual from lineitem group by 1),
c as (select t.*, case when actual is null then 'missing' when f.as_of < t.as_of then 'date_mismatch' when abs(actual - expected) / abs(expected) <= 0.25 then 'match' else 'mismatch' end as result from t left join f using (role))"""


@query(f"with {_CHECKED} select result, must_match, (result = 'match') = must_match as passed, count(*)::bigint as n from c group by all")
def reconciliation(spark, sf_dir):
    o = D.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("role"), F.to_date("o_orderdate").alias("as_of"), F.col("o_totalprice").alias("expected"), (F.col("o_orderstatus") != "P").alias("must_match"))
    li = D.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("role")).agg(F.min(F.to_date("l_shipdate")).alias("ship"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("actual"))
    # shipped on or after the order's date counts as the same date
    li = li.join(o.select("role", F.col("as_of").alias("ordered")), "role").select("role", F.when(F.col("ship") >= F.col("ordered"), F.col("ordered")).otherwise(F.col("ship")).alias("as_of"), "actual")
    done = alignment.reconciled(o, li, 0.25)
    return done.groupBy("result", "must_match", "passed").agg(F.count("*").alias("n"))


# --- positioning


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioning.typed(D.positions(spark, sf_dir))


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, contracts = table(_typed(spark, sf_dir), "typed"), D.contracts(spark, sf_dir)
    wrong = positioning.mismatched_contracts(rows, contracts)
    return positioning.derived(rows.join(small(wrong), "code", "left_anti"), contracts)


_POSITIONS = "select date, knowable_from, code, alias, net, round(net_pct_oi, 6) as net_pct_oi, open_interest_all, noncomm_positions_long_all, noncomm_positions_short_all, traders_noncomm from positions"


@query(D.sql("positions") + _POSITIONS)
def positions_derived(spark, sf_dir):
    return tidy(_derived(spark, sf_dir))


@query(
    D.sql("raw")
    + "select kind, week as date, 'C' || k as code, n_name || ' - EXCHANGE' as name, case when day(week) <> 31 then oi end as open_interest_all, lo as noncomm_positions_long_all, sh as noncomm_positions_short_all, tl as traders_noncomm_long_all, ts as traders_noncomm_short_all from raw cross join (values ('csv'), ('json')) t(kind)"
)
def s1_positions_read(spark, sf_dir):
    """Raw records written as JSON lines and as CSV, read back and typed; unreadable numbers are null."""
    raw, base = table(D.positions(spark, sf_dir), "raw"), f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    raw.write.json(f"{base}/json")
    raw.write.csv(f"{base}/csv", header=True)
    both = [positioning.typed(readers.read_positions(spark, f"{base}/{k}", k)).select(F.lit(k).alias("kind"), "*") for k in ("json", "csv")]
    return tidy(both[0].unionByName(both[1]))


@query("select 'C' || n_nationkey as code from nation where n_nationkey = 24")
def identity_guard(spark, sf_dir):
    return positioning.mismatched_contracts(_typed(spark, sf_dir), D.contracts(spark, sf_dir))


_SPLIT = datetime.date(1999, 1, 4)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A store up to the split, and fresh rows from a year before it on, the overlap with another net."""
    rows = table(_derived(spark, sf_dir), "derived")
    store = rows.filter(F.col("date") < _SPLIT)
    fresh = rows.filter(F.col("date") >= F.date_sub(F.lit(_SPLIT), 364)).withColumn("net", F.when(F.col("date") < _SPLIT, F.col("net") + 1).otherwise(F.col("net")))
    return store, fresh


@query(D.sql("positions") + _POSITIONS.replace(" net,", f" case when date < date '{_SPLIT}' and date >= date '{_SPLIT}' - 364 then net + 1 else net end as net,"))
def positions_upsert(spark, sf_dir):
    return tidy(positioning.upserted(*_halves(spark, sf_dir)))


@query(D.sql("positions") + f"select p.code, p.date from positions p left join (select code, max(date) as last_date from positions where date < date '{_SPLIT}' group by 1) s using (code) where last_date is null or p.date > last_date")
def positions_newer(spark, sf_dir):
    store, fresh = _halves(spark, sf_dir)
    return positioning.newer(fresh, positioning.last_dates(store)).select("code", "date")


@query(
    D.sql("positions")
    + f", c as (select 'C' || n_nationkey as code, lower(replace(n_name, ' ', '_')) as alias from nation union all select 'C99', 'empty') select c.code, c.alias, case when count(p.date) = 0 then 'no rows' else 'ok' end as status, count(p.date)::bigint as rows, (count(p.date) filter (where p.date >= date '{_SPLIT}'))::bigint as new_rows, min(p.date) as first_date, max(p.date) as last_date, (date '{TODAY}' - max(p.date))::bigint as staleness_days, round((list(net_pct_oi order by p.date desc) filter (where p.date is not null))[1], 6) as last_value, coalesce(date '{TODAY}' - max(p.date) > 14, false) as late from c left join positions p using (code) group by c.code, c.alias"
)
def positions_summary(spark, sf_dir):
    store = table(_derived(spark, sf_dir), "derived")
    return tidy(positioning.run_summary(store, store.filter(F.col("date") >= _SPLIT), D.contracts(spark, sf_dir), TODAY))


@query(D.sql("positions") + _POSITIONS)
def store_round_trip(spark, sf_dir):
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    sinks.write_store(_derived(spark, sf_dir), path)
    return tidy(readers.read_store(spark, path)).select("date", "knowable_from", "code", "alias", "net", "net_pct_oi", "open_interest_all", "noncomm_positions_long_all", "noncomm_positions_short_all", "traders_noncomm")


@query(D.sql("obs") + "select entity_id, series_id, date, date + 3 as knowable_from, value from obs")
def series_round_trip(spark, sf_dir):
    path = f"{shared_dir(spark)}/series-{uuid.uuid4().hex}"
    rows = D.obs(spark, sf_dir).select(*KEY, "date", F.date_add("date", 3).alias("knowable_from"), F.coalesce("value", F.lit(float("nan"))).alias("value"))
    sinks.write_series(rows, path, 8)
    return readers.read_series(spark, path).select(*KEY, "date", "knowable_from", "value")


@query(D.sql("positions") + _POSITIONS)
def stream_refresh(spark, sf_dir):
    """The same rows as positions_derived, arriving as two batches of report files through the stream."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    raw, contracts = table(D.positions(spark, sf_dir), "raw"), table(D.contracts(spark, sf_dir), "contracts")
    early = F.col("report_date_as_yyyy_mm_dd") < str(_SPLIT)
    for part in (early, ~early):
        raw.filter(part).write.mode("append").json(f"{base}/in")
        refresh(spark, f"{base}/in", f"{base}/store", f"{base}/checkpoint", contracts).awaitTermination()
    return tidy(read_refreshed(spark, f"{base}/store"))


# --- quality of series


def _profile(spark: SparkSession, sf_dir: str, mean_gap: bool = False) -> DataFrame:
    e = D.read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"))
    return series_quality.profile(e, ["user_id"], TODAY, mean_gap)


def _profile_sql(gap: str) -> str:
    return D.sql("profiles") + f"select user_id, points, first_date, last_date, round(last_value, 6) as last_value, round({gap}, 6) as gap_days, round((last_date - first_date) / 365.25, 2) as history_years, date '{TODAY}' - last_date as staleness_days, case when {gap} <= 2 then 'daily' when {gap} <= 10 then 'weekly' when {gap} <= 45 then 'monthly' when {gap} is not null then 'quarterly_or_sparser' end as inferred_frequency from profiles"


@query(_profile_sql("gap_days"))
def q1_profile(spark, sf_dir):
    return tidy(_profile(spark, sf_dir))


@query(_profile_sql("mean_gap"))
def q2_profile_mean_gap(spark, sf_dir):
    return tidy(_profile(spark, sf_dir, True))


@query(
    D.sql("profiles")
    + f"select user_id::varchar as ticker, case when user_id % 7 = 0 then 'INVALID_TICKER' when user_id % 5 = 0 and points < 10 then 'FIELD_DENIED' when points < 10 then 'NO_DATA' when date '{TODAY}' - last_date > 7 then 'STALE' when round((last_date - first_date) / 365.25, 2) < 0.08 then 'OK_SHORT_HISTORY' else 'OK' end as status from profiles"
)
def q3_status(spark, sf_dir):
    p = _profile(spark, sf_dir).withColumn("points", F.when(F.col("points") >= 10, F.col("points")))
    p = p.select(F.col("user_id").cast("string").alias("ticker"), F.lit("PX").alias("field"), F.lit("daily").alias("frequency"), "points", "history_years", "staleness_days", "user_id")
    kinds = F.when(F.col("user_id") % 7 == 0, "security").when(F.col("user_id") % 5 == 0, "field")
    errors = p.select("ticker", "field", kinds.alias("kind"), F.lit("not authorised").alias("category")).filter("kind is not null")
    return series_quality.status(p, errors, 0.08).select("ticker", "status")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates: brand = input, type = role, part = candidate, size = how it fared."""
    from pyspark.sql import Window

    p = D.read(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_brand").alias("input_id"),
        F.col("p_type").alias("role"),
        F.col("p_partkey").cast("string").alias("candidate"),
        (F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")) - 1).alias("position"),
        "p_size",
        F.col("p_type").startswith("S").alias("basket"),
        F.when(size <= 15, "OK").when(size <= 20, "OK_SHORT_HISTORY").when(size <= 35, "STALE").otherwise("NO_DATA").alias("status"),
    )


@query(D.sql("cands") + "select input_id, role, position // 3 as candidate, arg_min(candidate, case when status like 'OK%' then position else 1000000 + position end) as field, min(case when status like 'OK%' then 'usable' else 'none' end) <> 'none' or bool_or(status like 'OK%') as usable from cands group by all")
def q4_best_field(spark, sf_dir):
    tried = _candidates(spark, sf_dir).select("input_id", "role", F.floor(F.col("position") / 3).alias("candidate"), F.col("candidate").alias("field"), F.col("position").alias("field_position"), "status")
    return tidy(series_quality.best_field(tried).select("input_id", "role", "candidate", "field", series_quality.usable(F.col("status")).alias("usable")))


_ROLES = "roles as (select input_id, role, basket, array_to_string(case when basket then t else t[1:1] end, ',') as tickers, len(t) >= case when basket then 2 else 1 end as satisfied from (select input_id, role, basket, coalesce(list(candidate order by position) filter (where status like 'OK%'), []) as t from cands group by all))"


@query(D.sql("cands") + f", {_ROLES} select * from roles")
def q5_resolved(spark, sf_dir):
    return tidy(series_quality.resolved(_candidates(spark, sf_dir)))


@query(D.sql("cands") + f", {_ROLES} select input_id, case when bool_and(satisfied) then 'BUILDABLE' when bool_or(satisfied) then 'PARTIAL' else 'BLOCKED' end as verdict from roles group by 1")
def q6_verdicts(spark, sf_dir):
    return series_quality.verdicts(series_quality.resolved(_candidates(spark, sf_dir)))


@query(D.sql("cands") + f", {_ROLES}, v as (select input_id, case when bool_and(satisfied) then 'BUILDABLE' when bool_or(satisfied) then 'PARTIAL' else 'BLOCKED' end as verdict from roles group by 1) select verdict, count(*)::bigint as n from v group by 1")
def q6_verdict_counts(spark, sf_dir):
    return series_quality.verdict_counts(q6_verdicts(spark, sf_dir))


@query(D.sql("cands") + "select distinct trim(candidate) as ticker from cands where trim(candidate) <> ''")
def u3_tickers(spark, sf_dir):
    return series_quality.distinct_tickers(_candidates(spark, sf_dir))


_ORDERED = "n as (select c_mktsegment as contract, 'K' || o_custkey || o_orderpriority[1] as code, count(*) as n, min(cast(o_orderdate as date)) as first_date from orders join customer on c_custkey = o_custkey group by 1, 2)"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = D.read(spark, sf_dir, "orders"), D.read(spark, sf_dir, "customer")
    code = F.concat(F.lit("K"), F.col("o_custkey").cast("string"), F.substring("o_orderpriority", 1, 1))
    both = o.join(c.select("c_custkey", "c_mktsegment"), o.o_custkey == c.c_custkey)
    return both.groupBy(F.col("c_mktsegment").alias("contract"), code.alias("code")).agg(F.count("*").alias("n"), F.min(F.to_date("o_orderdate")).alias("first_date"))


@query(f"with {_ORDERED} select contract, code, n, place from (select *, row_number() over (partition by contract order by n desc, code) as place from n) where place <= 4")
def q7_longest(spark, sf_dir):
    return tidy(series_quality.longest(_series(spark, sf_dir), ["contract"]).select("contract", "code", "n", "place"))


@query(D.sql("cands") + "select input_id, role, arg_min(candidate, position) filter (where p_size > 40) as winner from cands group by all")
def q8_first_passing(spark, sf_dir):
    variants = _candidates(spark, sf_dir).select("input_id", "role", F.col("candidate").alias("id"), F.col("position").alias("rung"), (F.col("p_size") > 40).alias("passed"))
    return series_quality.first_passing(variants, ["input_id", "role"])


@query(f"with {_ORDERED} select contract, right(code, 1) as suffix, min(first_date) as earliest, count(*)::bigint as n_series from n group by 1, 2")
def q9_starts_by_suffix(spark, sf_dir):
    return series_quality.starts_by_suffix(_series(spark, sf_dir), ["contract"])


@query(
    D.sql("cands")
    + "select input_id, input_id as input_name, 'index' as kind, 'daily' as frequency, role, position::bigint as position, candidate, case when basket then 'NAV' else 'PX_LAST' end as field, case when basket then 'AUM' else '' end as extra_fields from cands"
)
def s7_flat_catalogue(spark, sf_dir):
    """Candidates nested per input and role, one file per brand in the shared folder, read and flattened."""
    c = _candidates(spark, sf_dir)
    names = F.transform(F.array_sort(F.collect_list(F.struct("position", "candidate"))), lambda x: x["candidate"])
    none = F.lit(None).cast("string")
    by = c.groupBy("input_id", "role", "basket").agg(names.alias("candidates"))
    series = F.struct("role", none.alias("field"), F.when(F.col("basket"), "NAV").alias("price_field"), F.when(F.col("basket"), "AUM").alias("weight_field"), F.lit(None).cast("array<string>").alias("field_alternates"), "candidates")
    one = by.groupBy("input_id").agg(F.collect_list(series).alias("series"))
    entry = F.struct(F.col("input_id").alias("id"), F.col("input_id").alias("name"), F.lit("index").alias("kind"), F.lit("daily").alias("frequency"), none.alias("field"), F.lit(None).cast("array<string>").alias("field_alternates"), "series")
    nested = one.select(F.array(entry).alias("inputs"), F.struct(F.lit("PX_LAST").alias("field")).alias("defaults"))
    path = f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}"
    nested.write.json(path)
    flat = readers.flat_catalogue(spark.read.schema(readers.schemas.CATALOGUE).json(path))
    return tidy(flat.drop("field_alternates"))


@query(
    D.sql("cands")
    + "select input_id as target, 'S' || (candidate::bigint % 50) as code, min(role) as query, arg_min(p_size, (role, position))::bigint as n from cands where status <> 'NO_DATA' group by all"
)
def s6_flat_report(spark, sf_dir):
    """A probe report per brand with its types as queries and parts as hits, flattened to codes that are ok."""
    c = _candidates(spark, sf_dir)
    code = F.concat(F.lit("S"), (F.col("candidate").cast("long") % 50).cast("string"))
    none = lambda t: F.lit(None).cast(t)
    series = F.struct((F.col("status") != "NO_DATA").alias("ok"), code.alias("code"), F.col("p_size").cast("long").alias("n"), none("string").alias("first_date"), none("string").alias("last_date"), none("string").alias("inferred_frequency"), none("double").alias("history_years"), none("long").alias("staleness_days"))
    hit = F.struct(F.struct(code.alias("code"), none("string").alias("title"), none("string").alias("region"), none("string").alias("frequency")).alias("search_hit"), series.alias("series"))
    hits = c.withColumn("hit", hit).groupBy("input_id", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "hit"))), lambda x: x["hit"]).alias("hits"))
    queries = hits.groupBy("input_id").agg(F.map_from_entries(F.collect_list(F.struct("role", F.struct(none("string").alias("error"), "hits")))).alias("queries"))
    report = queries.select(F.create_map("input_id", F.struct(F.col("input_id").alias("label"), "queries")).alias("targets"))
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    report.write.json(path)
    return tidy(readers.flat_report(spark.read.schema(readers.schemas.PROBE_REPORT).json(path)).select("target", "code", "query", "n"))
