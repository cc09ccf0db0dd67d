"""Trend queries over poll points."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.operators import trends
from hustings.plans.tables import POLLS_SQL, polls, table

NOW = "2024-01-31"


def monthly_mean(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.avg("o_totalprice"), 6).alias("mean"))


def daily_mean(spark, sf_dir):
    return polls(spark, sf_dir).groupBy("party", "day").agg(F.round(F.avg("pct"), 6).alias("mean"), F.count("*").alias("n"))


def kernel_smooth(spark, sf_dir):
    s = trends.kernel_smooth(polls(spark, sf_dir), ["party"], "day", "pct", bandwidth=3)
    return s.select("party", "t", F.round("mean", 6).alias("mean"))


def kernel_band(spark, sf_dir):
    s = trends.kernel_smooth(polls(spark, sf_dir), ["party", "agency"], "day", "pct", bandwidth=5)
    return s.select("party", "agency", "t", F.round("mean", 6).alias("mean"), F.round("sd", 5).alias("sd"))


def kernel_segments(spark, sf_dir):
    p = polls(spark, sf_dir).filter("pct > 150")
    s = trends.kernel_smooth(p, ["user_id"], "day", "pct", bandwidth=2, max_gap=1)
    return s.select("user_id", "t", F.round("mean", 6).alias("mean"), "segment")


def peak_filter(spark, sf_dir):
    s = trends.kernel_smooth(polls(spark, sf_dir), ["party", "agency"], "day", "pct", bandwidth=5)
    return trends.peaks(s, ["party", "agency"], 60).select("party", "agency", F.round("peak", 6).alias("peak"))


def house_effects(spark, sf_dir):
    h = trends.house_effects(polls(spark, sf_dir), ["party"], "day", "pct", "agency", "k", bandwidth=3)
    return h.select("agency", "n", F.round("effect", 6).alias("effect"))


def house_adjusted(spark, sf_dir):
    p = polls(spark, sf_dir)
    h = trends.house_effects(p, ["party"], "day", "pct", "agency", None, bandwidth=3)
    return trends.without_house(p, h, "agency", "pct").select("event_id", F.round("adjusted", 6).alias("adjusted"))


def decay_weighted_top2(spark, sf_dir):
    p = polls(spark, sf_dir).withColumn("label", F.concat("party", F.lit(" "), F.col("k").cast("string")))
    out = trends.decayed_top2(p, ["user_id"], F.col("party"), "label", "pct", "day", "k", F.when(F.col("k") % 3 == 0, F.col("k") / 20), NOW, recent_n=50)
    return out.select("user_id", "first_name", "second_name", *[F.round(c, 6).alias(c) for c in ("first_mean", "second_mean", "error", "gap", "effective_gap")], "n_recent", "low_recent")


def mad_outliers(spark, sf_dir):
    m = trends.mad_outliers(polls(spark, sf_dir), ["user_id", "party"], "day", "pct", "event_id", days=5)
    return m.select("event_id", F.col("n").cast("long").alias("n"), F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


def sessions_gap(spark, sf_dir):
    return trends.gap_sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600, ["event_id"]).select("event_id", "session")


def spearman_corr(spark, sf_dir):
    s = trends.spearman(polls(spark, sf_dir), ["party"], "pct", "k", ["event_id"])
    return s.select("party", "n", F.round("rho", 6).alias("rho"))


def nearest_month(spark, sf_dir):
    # months of filled orders against those of all others; of a month the least key, so that months meet and not orders
    d = table(spark, sf_dir, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("m"), "o_orderkey", F.col("o_orderstatus").eqNullSafe("F").alias("filled"))
    o = d.filter("filled").select("o_custkey", "m").distinct()
    c = d.filter("NOT filled").groupBy("o_custkey", F.col("m").alias("m2")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return trends.nearest_month(o, c, ["o_custkey"], "m", "m2", "o_orderkey", ["o_orderkey"]).select("o_custkey", "m", F.col("o_orderkey").alias("nearest"))


def latest_series_top(spark, sf_dir):
    p = polls(spark, sf_dir).withColumn("series", F.concat_ws("-", "party", "user_id"))
    return trends.latest_series_top(p, "series", "pct", "day", NOW, n=10, within=3).select("series", F.round("mean", 6).alias("mean"), "last_seen")


QUERIES = {
    f.__name__: f
    for f in (
        monthly_mean, daily_mean, kernel_smooth, kernel_band, kernel_segments, peak_filter, house_effects, house_adjusted, decay_weighted_top2, mad_outliers,
        sessions_gap, spearman_corr, nearest_month, latest_series_top,
    )
}


def _smooth(by: str, bandwidth: float, max_gap: int = 75, where: str = "true") -> str:
    keys = by.split(", ")
    on = " and ".join(f"g.{k} = b.{k}" for k in keys)
    g = ", ".join(f"g.{k}" for k in keys)
    return f"""{POLLS_SQL}, p as (select * from polls where {where}), b as (select {by}, day, count(pct) as n, sum(pct) as s, sum(pct * pct) as q from p group by all),
span as (select {by}, min(day) as a, max(day) as z, sum(n) as points from b group by all),
g as (select {by}, points, cast(unnest(generate_series(a, z, interval 1 day)) as date) as t from span),
k as (select {g}, g.t, points, min(abs(t - day)) as nearest, sum(exp(-pow(t - day, 2) / pow({bandwidth}, 2)) * n) as w, sum(exp(-pow(t - day, 2) / pow({bandwidth}, 2)) * s) as ws,
  sum(exp(-pow(t - day, 2) / pow({bandwidth}, 2)) * q) as wq from g join b on {on} group by all),
f as (select *, nearest > {max_gap} as far, case when not (nearest > {max_gap}) and coalesce(lag(nearest > {max_gap}) over (partition by {by} order by t), true) then 1 else 0 end as fresh from k),
smooth as (select * from (select {by}, t, points, far, ws / w as mean, case when points >= 2 then sqrt(greatest(0, wq / w - pow(ws / w, 2))) end as sd,
  cast(sum(fresh) over (partition by {by} order by t rows unbounded preceding) as bigint) as segment from f) where not far)"""


def _effects(weight: str) -> str:
    return f"""{POLLS_SQL}, b as (select party, day, count(pct) as n, sum(pct) as s from polls group by all),
tr as (select x.party, x.day, sum(exp(-pow(x.day - y.day, 2) / 9.0) * y.s) / sum(exp(-pow(x.day - y.day, 2) / 9.0) * y.n) as m from b x join b y on x.party = y.party group by all),
r as (select agency, pct - m as r, {weight} as w from polls join tr on polls.party = tr.party and polls.day = tr.day),
effects as (select agency, count(*) as n, case when count(*) < 3 then 0 else count(*) / (count(*) + 10.0) * (sum(w * r) / sum(w)) end as effect from r group by 1)"""


ORACLE_SQL = {
    "monthly_mean": "select o_orderpriority, strftime(o_orderdate, '%Y-%m') as month, round(avg(o_totalprice), 6) as mean from orders group by all",
    "daily_mean": f"with {POLLS_SQL} select party, day, round(avg(pct), 6) as mean, count(*) as n from polls group by all",
    "kernel_smooth": f"with {_smooth('party', 3)} select party, t, round(mean, 6) as mean from smooth",
    "kernel_band": f"with {_smooth('party, agency', 5)} select party, agency, t, round(mean, 6) as mean, round(sd, 5) as sd from smooth",
    "kernel_segments": f"with {_smooth('user_id', 2, 1, 'pct > 150')} select user_id, t, round(mean, 6) as mean, segment from smooth",
    "peak_filter": f"with {_smooth('party, agency', 5)} select party, agency, round(max(mean), 6) as peak from smooth group by all having max(mean) >= 60",
    "house_effects": f"with {_effects('sqrt(case when coalesce(k, 0) = 0 then 1 else k end)')} select agency, n, round(effect, 6) as effect from effects",
    "house_adjusted": f"with {_effects('1.0')} select event_id, round(pct - coalesce(effect, 0), 6) as adjusted from polls left join effects on polls.agency = effects.agency",
    "decay_weighted_top2": f"""with {POLLS_SQL}, p as (select *, exp(-greatest(0, date '{NOW}' - day) / 7.0) * (case when coalesce(k, 0) = 0 then 500 else k end) as w,
  case when k % 3 = 0 then k / 20 end as err, party || ' ' || k as label from polls where pct between 0 and 100),
m as (select user_id, party, sum(pct * w) / sum(w) as mean, arg_max(label, (day, label)) as name from p group by all),
r as (select *, row_number() over (partition by user_id order by mean desc, party) as rk from m),
t as (select user_id, max(name) filter (rk = 1) as first_name, max(mean) filter (rk = 1) as first_mean, max(name) filter (rk = 2) as second_name, max(mean) filter (rk = 2) as second_mean from r where rk <= 2 group by 1),
i as (select user_id, avg(err) as error, count(*) filter (date '{NOW}' - day <= 30) as n_recent from p group by 1)
select user_id, first_name, second_name, round(first_mean, 6) as first_mean, round(second_mean, 6) as second_mean, round(error, 6) as error, round(first_mean - second_mean, 6) as gap,
  round(greatest(0, first_mean - second_mean - coalesce(error, 0)), 6) as effective_gap, n_recent, n_recent < 50 as low_recent from t join i using (user_id)""",
    "mad_outliers": f"""with {POLLS_SQL}, j as (select a.event_id, a.pct as x, b.pct as y from polls a join polls b on a.user_id = b.user_id and a.party = b.party and abs(a.day - b.day) <= 5),
m as (select event_id, x, count(*) as n, median(y) as md from j group by all having count(*) >= 3),
d as (select m.event_id, any_value(m.x) as x, any_value(n) as n, any_value(md) as md, median(abs(y - md)) as mad from m join j on m.event_id = j.event_id group by 1)
select event_id, n, round(md, 6) as median, round(mad, 6) as mad from d where mad >= 2 and abs(x - md) > greatest(15, 4 * mad)""",
    "sessions_gap": """with f as (select *, case when coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) > 21600000000, true) then 1 else 0 end as fresh from events)
select event_id, cast(sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as session from f""",
    "spearman_corr": f"""with {POLLS_SQL}, r as (select party, row_number() over (partition by party order by pct, event_id) as x, row_number() over (partition by party order by k nulls first, event_id) as y from polls)
select party, count(*) as n, round(corr(x, y), 6) as rho from r group by 1""",
    "nearest_month": """with o as (select distinct o_custkey, cast(date_trunc('month', o_orderdate) as date) as m from orders where o_orderstatus = 'F'),
c as (select o_custkey as ck, cast(date_trunc('month', o_orderdate) as date) as m2, o_orderkey from orders where o_orderstatus is distinct from 'F')
select o_custkey, m, o_orderkey as nearest from o left join c on o_custkey = ck
qualify row_number() over (partition by o_custkey, m order by m <> m2, year(m) <> year(m2), abs((year(m) - year(m2)) * 12 + month(m) - month(m2)), o_orderkey) = 1""",
    "latest_series_top": f"""with {POLLS_SQL}, s as (select party || '-' || user_id as series, avg(pct) as mean, max(day) as last_seen from polls group by 1)
select series, round(mean, 6) as mean, last_seen from s where date '{NOW}' - last_seen <= 3 order by s.mean desc, series limit 10""",
}
