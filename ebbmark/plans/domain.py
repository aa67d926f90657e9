"""The driver's tables in this library's terms, as Spark frames and as DuckDB common table expressions.

obs: entity = order status, series = order priority, one value a day (the day's order total). prices: one series per entity. legs: line items by return flag. positions: weekly
line-item quantities by supplier nation. Money is summed as decimals before it becomes doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbmark.core import schemas

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
CLUSTERS = (("1-URGENT", "rush"), ("2-HIGH", "rush"), ("3-MEDIUM", "plain"), ("4-NOT SPECIFIED", "plain"), ("5-LOW", "slow"))
RULES = tuple((p, "sell", "gt", 90.0) for p in PRIORITIES) + tuple((p, "buy", "lt", 10.0) for p in PRIORITIES[:3])
MIN_PERIODS = 60


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    by = o.groupBy(F.col("o_orderstatus").alias("entity_id"), F.col("o_orderpriority").alias("series_id"), day.alias("date")).agg(_money("o_totalprice").alias("v"))
    return by.select("entity_id", "series_id", "date", F.col("v").alias("value"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("entity_id"), F.to_date("o_orderdate").alias("date")).agg(_money("o_totalprice").alias("value")).select("entity_id", F.lit("total").alias("series_id"), "date", "value")


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    by = li.groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("date")).agg(_money("l_extendedprice").alias("value"), _money("l_quantity").alias("weight"))
    return by.select(F.lit("ALL").alias("entity_id"), "series_id", "date", "value", "weight")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, "expanding", None, MIN_PERIODS) for r in RULES], schemas.RULES)


def inputs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLUSTERS), schemas.INPUTS)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw weekly records, all text, as a source would deliver them; weeks of the 53rd kind hold an unreadable number."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag", F.date_trunc("week", "l_shipdate").cast("date").alias("week"))
    su = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    na = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    qty = lambda flag=None: F.coalesce(F.sum(F.when(F.lit(True) if flag is None else F.col("l_returnflag") == flag, F.col("l_quantity").cast("decimal(18,2)"))), F.lit(0)).cast("long").cast("string")
    by = li.join(su, li.l_suppkey == su.s_suppkey).groupBy("s_nationkey", "week").agg(
        qty().alias("open_interest_all"),
        qty("A").alias("noncomm_positions_long_all"),
        qty("R").alias("noncomm_positions_short_all"),
        F.count_if(F.col("l_returnflag") == "A").cast("string").alias("traders_noncomm_long_all"),
        F.count_if(F.col("l_returnflag") == "R").cast("string").alias("traders_noncomm_short_all"),
    )
    named = by.join(F.broadcast(na), by.s_nationkey == na.n_nationkey)
    return named.select(
        F.date_format("week", "yyyy-MM-dd").alias("report_date_as_yyyy_mm_dd"),
        F.concat(F.lit("C"), "s_nationkey").alias("cftc_contract_market_code"),
        F.concat("n_name", F.lit(" - EXCHANGE")).alias("market_and_exchange_names"),
        F.when(F.dayofmonth("week") == 31, "n/a").otherwise(F.col("open_interest_all")).alias("open_interest_all"),
        "noncomm_positions_long_all",
        "noncomm_positions_short_all",
        "traders_noncomm_long_all",
        "traders_noncomm_short_all",
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract per nation; the last one expects another name, and a 26th has no records."""
    na = read(spark, sf_dir, "nation")
    rows = na.select(
        F.concat(F.lit("C"), "n_nationkey").alias("code"),
        F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("alias"),
        F.when(F.col("n_nationkey") == 24, "NOWHERE").otherwise(F.col("n_name")).alias("expect_name_contains"),
        F.when(F.col("n_regionkey") < 2, -1).otherwise(1).alias("risk_sign"),
        (F.col("n_regionkey") == 1).alias("in_equities_input"),
        F.lit(True).alias("in_risk_basket"),
    )
    return rows.unionByName(spark.createDataFrame([("C99", "empty", "EMPTY", 1, False, False)], schemas.CONTRACTS))


def sql(*names: str, boots: int = 500, horizons: tuple[int, ...] = (5, 21)) -> str:
    """with-clause of the named expressions and what they need; bootstraps draw ``boots`` replicates."""
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        needs, body = CTE[name]
        for n in needs:
            add(n)
        body = body.replace("{boots}", str(boots)).replace("{fwd}", " union all ".join(f"select *, {h} as h, lead(value, {h}) over ({W}) / nullif(value, 0) - 1 as fwd from prices" for h in horizons))
        seen.setdefault(name, f"{name} as materialized ({body})")

    for n in names:
        add(n)
    return "with " + ",\n".join(seen.values()) + "\n"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


W = "partition by entity_id, series_id order by date"
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "obs": (
        (),
        "select entity_id, series_id, date, v as value from (select o_orderstatus as entity_id, o_orderpriority as series_id, cast(o_orderdate as date) as date,"
        " cast(sum(cast(o_totalprice as decimal(18,2))) as double) as v from orders group by 1, 2, 3)",
    ),
    "prices": (
        (),
        "select o_orderstatus as entity_id, 'total' as series_id, cast(o_orderdate as date) as date, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value from orders group by 1, 2, 3",
    ),
    "legs": (
        (),
        "select 'ALL' as entity_id, l_returnflag as series_id, cast(l_shipdate as date) as date, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as value, cast(sum(cast(l_quantity as decimal(18,2))) as double) as weight from lineitem group by 1, 2, 3",
    ),
    "rules": ((), f"select * from (values {_values((*r, dict(CLUSTERS)[r[0]]) for r in RULES)}) r(input_id, side, rule, pct, cluster)"),
    "nn": (("obs",), f"select *, row_number() over ({W}) as rn from obs where value is not null"),
    "ranks": (
        ("nn",),
        f"select a.entity_id, a.series_id as input_id, a.date, case when a.rn >= {MIN_PERIODS} then count(*) filter (where b.value <= a.value) / a.rn::double end as rank"
        " from nn a join nn b on a.entity_id = b.entity_id and a.series_id = b.series_id and b.rn <= a.rn group by a.entity_id, a.series_id, a.date, a.rn",
    ),
    "grid": (
        ("ranks", "rules"),
        "select d.entity_id, d.side, d.date, r.input_id, r.cluster, k.rank, case when r.rule = 'gt' then greatest(0, least(1, (k.rank - r.pct / 100) / (1 - r.pct / 100))) else greatest(0, least(1, (r.pct / 100 - k.rank) / (r.pct / 100))) end + 0 * k.rank as hinge,"
        " case when r.rule = 'gt' then k.rank >= r.pct / 100 else k.rank <= r.pct / 100 end as fired"
        " from (select distinct k.entity_id, r.side, k.date from ranks k join rules r using (input_id)) d join rules r on r.side = d.side left join ranks k on k.entity_id = d.entity_id and k.date = d.date and k.input_id = r.input_id",
    ),
    "clusters": (("grid",), "select entity_id, side, date, cluster, avg(hinge) as h from grid group by all"),
    "one": (
        ("grid", "clusters"),
        "select g.*, c.improved, fired_count / nullif(denominator, 0)::double as replica from (select entity_id, side, date, count(rank) as denominator, count(*) filter (where fired) as fired_count,"
        " coalesce(list_sort(list(input_id) filter (where rank is null)), []) as dropped from grid group by all) g join (select entity_id, side, date, avg(h) as improved from clusters group by all) c using (entity_id, side, date)",
    ),
    "reads": (
        ("one",),
        "select entity_id, side, 'replica' as mode, date, replica as reading, denominator, fired_count, dropped from one union all select entity_id, side, 'improved', date, improved, denominator, fired_count, dropped from one",
    ),
    "ret": (("obs",), f"select entity_id, series_id, date, value, value / nullif(lag(value) over ({W}), 0) - 1 as r from obs"),
    "vol": (("ret",), f"select *, case when count(r) over w >= 60 then stddev_samp(r) over w * sqrt(252.0) end as vol from ret window w as ({W} rows 59 preceding)"),
    "rsi": (
        ("obs",),
        f"select entity_id, series_id, date, case when down = 0 then 100.0 when down is not null then 100 - 100 / (1 + up / down) end as value from (select *, case when count(d) over w >= 14 then avg(greatest(d, 0)) over w end as up, case when count(d) over w >= 14 then avg(greatest(-d, 0)) over w end as down"
        f" from (select *, value - lag(value) over ({W}) as d from obs) window w as ({W} rows 13 preceding))".replace("avg(greatest(d, 0))", "avg(case when d is not null then greatest(d, 0) end)").replace("avg(greatest(-d, 0))", "avg(case when d is not null then greatest(-d, 0) end)"),
    ),
    "zlegs": (
        ("legs",),
        f"select *, case when mad <> 0 then greatest(-3, least(3, (value - med) / (1.4826 * mad))) end as z from (select *, case when count(dev) over w >= 63 then quantile_cont(dev, 0.5) over w end as mad from"
        f" (select *, abs(value - med) as dev from (select *, case when count(value) over w >= 63 then quantile_cont(value, 0.5) over w end as med from legs window w as ({W} rows 251 preceding))) window w as ({W} rows 251 preceding))",
    ),
    "fwd": (("prices",), "select entity_id, date, h as horizon, fwd from ({fwd})"),
    "signals": (("one",), "select entity_id, side, date, replica >= 0.2 as sig, replica as reading from one"),
    "pairs": (
        ("fwd", "signals"),
        "select entity_id, side, date, horizon, fwd, sig, reading, case when side = 'sell' then fwd < 0 else fwd > 0 end::int::double as hit, row_number() over (partition by entity_id, side, horizon order by date) as rn from fwd join signals using (entity_id, date) where fwd is not null and sig is not null",
    ),
    "groups": (("pairs",), "select entity_id, side, horizon, count(*) as n, count(*) filter (where sig) as n1, avg(fwd) filter (where sig) as m1, avg(fwd) filter (where not sig) as m0 from pairs group by all"),
    "scores": (
        ("pairs", "groups"),
        "select entity_id, side, horizon, rn, case when sig then (fwd - m1) / n1 else -(fwd - m0) / (n - n1) end as g from pairs join groups using (entity_id, side, horizon) where n >= 30 and n1 >= 5 and n - n1 >= 5",
    ),
    "hac": (
        ("scores",),
        "select a.entity_id, a.side, a.horizon, sum(case when a.rn = b.rn then 1.0 else 2 * (1 - (b.rn - a.rn) / (greatest(a.horizon - 1, 1) + 1)::double) end * a.g * b.g) as v from scores a join scores b on a.entity_id = b.entity_id and a.side = b.side and a.horizon = b.horizon and b.rn between a.rn and a.rn + greatest(a.horizon - 1, 1) group by all",
    ),
    "md": (
        ("groups", "hac"),
        "select g.entity_id, g.side, g.horizon, case when v is not null then m1 - m0 end as difference, sqrt(greatest(v, 0)) as se, case when v > 0 then (m1 - m0) / sqrt(v) end as t_stat, n, n1 as n_signal, case when v is not null then n / horizon::double end as n_effective, case when v is not null then greatest(horizon - 1, 1) end as lags from groups g left join hac using (entity_id, side, horizon)",
    ),
    "offsets": (
        ("pairs",),
        "select entity_id, side, horizon, (rn - 1) % horizon as k, count(*) as n, count(*) filter (where sig) as n1, avg(fwd) filter (where sig) - avg(fwd) filter (where not sig) as d from pairs group by all",
    ),
    "apart": (
        ("offsets",),
        "select entity_id, side, horizon, case when sum(n) >= 4 * horizon then avg(d) filter (where ok) end as difference, case when sum(n) >= 4 * horizon then stddev_pop(d) filter (where ok) end as dispersion, coalesce(case when sum(n) >= 4 * horizon then avg(n) filter (where ok) end, 0) as n_blocks, case when sum(n) >= 4 * horizon then count(*) filter (where ok) else 0 end::double as offsets_used from (select *, n1 >= 3 and n - n1 >= 3 as ok from offsets) group by entity_id, side, horizon",
    ),
    "blocks": (
        ("pairs",),
        "select *, least(len, n - before) as length from (select *, coalesce(sum(len) over (partition by entity_id, side, horizon, rep order by j rows between unbounded preceding and 1 preceding), 0)::bigint as before from"
        " (select entity_id, side, horizon, n, rep, j, floor(('0x' || h[1:8])::bigint * n / 4294967296.0)::bigint as start, case when j = last then n else least(n, 1 + floor(ln((('0x' || h[9:16])::bigint + 0.5) / 4294967296.0) / ln(1 - 1 / b))::bigint) end as len from"
        " (select *, md5('0|' || entity_id || '|' || side || '|' || horizon || '|' || rep || '|' || j) as h from (select *, unnest(range(0, last + 1)) as j from"
        " (select *, ceil(2 * n / b)::bigint + 19 as last, unnest(range(0, {boots})) as rep from (select entity_id, side, horizon, count(*) as n, greatest(horizon, 2)::double as b from pairs group by all)))))) where before < n",
    ),
    "totals": (
        ("pairs",),
        "select entity_id, side, horizon, rn as at, sum(hit) over w as hit, sum(sig::int) over w as sig, sum(hit * sig::int) over w as both_ from pairs window w as (partition by entity_id, side, horizon order by rn)"
        " union all select distinct entity_id, side, horizon, 0, 0, 0, 0 from pairs",
    ),
    "lifts": (
        ("blocks", "totals"),
        "select entity_id, side, horizon, case when count(*) >= 20 then quantile_cont(lift, 0.025) end as lift_lo, case when count(*) >= 20 then quantile_cont(lift, 0.975) end as lift_hi from"
        " (select b.entity_id, b.side, b.horizon, rep, sum(e.both_ - s.both_ + w * z.both_) / nullif(sum(e.sig - s.sig + w * z.sig), 0) - sum(e.hit - s.hit + w * z.hit) / any_value(b.n) as lift, sum(e.sig - s.sig + w * z.sig) as n1, any_value(b.n) as n"
        " from (select *, (start + length > n)::int as w, start + length - case when start + length > n then n else 0 end as stop from blocks) b join totals s on (s.entity_id, s.side, s.horizon, s.at) = (b.entity_id, b.side, b.horizon, b.start)"
        " join totals e on (e.entity_id, e.side, e.horizon, e.at) = (b.entity_id, b.side, b.horizon, b.stop) join totals z on (z.entity_id, z.side, z.horizon, z.at) = (b.entity_id, b.side, b.horizon, b.n) group by 1, 2, 3, 4) where n1 >= 5 and n - n1 >= 5 group by 1, 2, 3",
    ),
    "rates": (("one",), "select entity_id, side, 'replica' as mode, sum(fired_count) / sum(denominator)::double as p from one group by 1, 2"),
    "binomial": (
        ("rates",),
        "select *, sum(pmf) over (partition by entity_id, side, k order by j) as cdf from (select entity_id, side, mode, k, j, case when p <= 0 then (j = 0)::int::double when p >= 1 then (j = k)::int::double"
        " else exp(k * ln(1 - p) + sum(case when j > 0 then ln((k - j + 1) / j::double) + ln(p / (1 - p)) else 0 end) over (partition by entity_id, side, k order by j)) end as pmf"
        " from (select *, unnest(range(0, k + 1)) as j from (select *, unnest(range(2, 9)) as k from rates)))",
    ),
    "raw": (
        (),
        "select s_nationkey as k, n_name, week, oi, lo, sh, tl, ts from (select s_nationkey, cast(date_trunc('week', l_shipdate) as date) as week, sum(l_quantity::decimal(18,2))::double as oi, coalesce(sum(l_quantity::decimal(18,2)) filter (where l_returnflag = 'A'), 0)::double as lo,"
        " coalesce(sum(l_quantity::decimal(18,2)) filter (where l_returnflag = 'R'), 0)::double as sh, count(*) filter (where l_returnflag = 'A')::double as tl, count(*) filter (where l_returnflag = 'R')::double as ts from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2) join nation on n_nationkey = s_nationkey",
    ),
    "positions": (
        ("raw",),
        "select week as date, week + 3 as knowable_from, 'C' || k as code, lower(replace(n_name, ' ', '_')) as alias, lo - sh as net, case when day(week) <> 31 then (lo - sh) / nullif(oi, 0) end as net_pct_oi, case when day(week) <> 31 then oi end as open_interest_all, lo as noncomm_positions_long_all, sh as noncomm_positions_short_all, tl + ts as traders_noncomm from raw where k <> 24",
    ),
    "profiles": (
        (),
        "select user_id, points, first_date, last_date, last_value, case when points > 5 then gap end as gap_days, case when points > 5 then (last_date - first_date) / nullif(points - 1, 0)::double end as mean_gap from (select user_id, count(*) as points, min(date) as first_date, max(date) as last_date, arg_max(value, date) as last_value, quantile_cont(gap, 0.5) as gap from"
        " (select *, date - lag(date) over (partition by user_id order by date) as gap from (select user_id, cast(ts as date) as date, sum(value::decimal(18,4))::double as value from events group by 1, 2)) group by user_id)",
    ),
    "cands": (
        (),
        "select p_brand as input_id, p_type as role, cast(p_partkey as varchar) as candidate, row_number() over (partition by p_brand, p_type order by p_partkey) - 1 as position, p_size, p_type like 'S%' as basket, case when p_size <= 15 then 'OK' when p_size <= 20 then 'OK_SHORT_HISTORY' when p_size <= 35 then 'STALE' else 'NO_DATA' end as status from part",
    ),
}
