"""Learners in batch and in a stream, calibration, curves through samples, lags, bands of revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calibration, scores
from ..operators.learners import LEVELS, walk_forward
from ..operators.timeaxis import monotone_cubic, peak_lag
from ..streaming.live import distinct, learn, sessions
from ..streaming.windows import gathered, opened
from .scalars import _STEPS, lag_cross_corr

#: At or above every value of the events.
CAPACITY = 1000.0


def _readings(events: DataFrame) -> DataFrame:
    slot = (F.hour("ts") * 2 + F.floor(F.minute("ts") / 30)).cast("long")
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("step"), "value", slot.alias("slot"), F.lit(CAPACITY).alias("capacity"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _scored(forecasts: DataFrame) -> DataFrame:
    fan = F.zip_with(F.array(*[F.lit(q) for q in LEVELS]), "quantiles", lambda q, v: F.struct(q.alias("q"), v.alias("v")))
    made = forecasts.withColumn("_fan", fan).drop("quantiles")  # a column, as its many uses would each make it anew
    return made.withColumns({"crps": scores.crps(F.col("_fan"), F.col("actual")), "pit": scores.pit(F.col("_fan"), F.col("actual"))}).drop("_fan")


def walk_forward_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(walk_forward(_readings(_events(spark, sf_dir))))


def walk_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill, coverage and CRPS by horizon, weighted by how many forecasts a key has."""
    made = _scored(walk_forward(_readings(_events(spark, sf_dir)), horizons=(1, 6, 12), warm_up=12))
    hit = F.col("actual").between(F.col("lo"), F.col("hi")).cast("int")
    return made.groupBy("horizon").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("forecast") - F.col("actual"))).alias("mae"), F.avg("crps").alias("crps"), F.avg(hit).alias("covered"))


def stream_learner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(gathered(learn(_readings(opened(spark, f"{sf_dir}/events.parquet"))), "append"))


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gathered(sessions(opened(spark, f"{sf_dir}/events.parquet"), "user_id", "ts", "6 hours"), "complete")
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n", F.round("value", 4).alias("value"))


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream sent twice, each event once."""
    sent = opened(spark, f"{sf_dir}/events.parquet").union(opened(spark, f"{sf_dir}/events.parquet"))
    return gathered(distinct(sent, ["event_id"], "ts").select("event_id", "user_id", "event_type", "value"), "append")


def pchip_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    grid = e.where("event_type = 'view'").select("user_id", "event_id")
    samples = e.where("event_type = 'click'").select("user_id", "event_id", "value")
    return monotone_cubic(grid, samples, "user_id", "event_id", "value").withColumn("value", F.round("value", 5))


def peak_lag_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = peak_lag(lag_cross_corr(spark, sf_dir), "event_type", 12)
    return out.select("event_type", "lag", F.round("prominence", 5).alias("prominence"), F.round("strength", 5).alias("strength"))


def revenue_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    fan = F.array(*[F.struct(F.lit(q).alias("q"), (v * m).alias("v")) for q, m in ((0.5, 1.0), (0.1, 0.5), (0.9, 1.5))])
    band = scores.revenue_band(fan, F.get_json_object("props", "$.k").cast("double") - 30, F.lit(100.0), 30.0)
    return _events(spark, sf_dir).withColumn("b", band).select("event_id", *[F.round(f"b.{c}", d).alias(c) for c, d in (("expected", 6), ("p10", 6), ("p90", 6), ("per_mw", 8))])


def _histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(calibration.histogram(F.col("value") / 150).alias("counts"), calibration.covered_exactly(F.col("value") / 150, 0.8).alias("inside"))


def pit_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("counts")
    return _histograms(spark, sf_dir).select(
        "event_type", F.round(calibration.chi_squared(c), 4).alias("chi_squared"), F.round(calibration.covered(c, 10, 0.5), 6).alias("inside50"),
        F.round(calibration.covered(c, 10, 0.8), 6).alias("inside80"), F.round("inside", 6).alias("inside80_exactly"), F.round(F.element_at(calibration.bars(c), 1), 6).alias("first_bar"),
    )


def pit_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _histograms(spark, sf_dir).withColumn("p", calibration.chi_squared_tail(calibration.chi_squared(F.col("counts")), F.lit(9)))
    return found.select("event_type", (F.col("p") > 0.05).alias("uniform"), calibration.shape(F.col("counts"), 10).alias("shape"))


def gamma_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regularised upper gamma function at whole and at half orders of each supplier's balance."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    x, a = F.col("s_acctbal") / 500, (F.col("s_suppkey") % 9 + 1).cast("double")
    tails = s.select("s_suppkey", calibration.gamma_tails(a, x).alias("whole"), calibration.gamma_tails(a + 0.5, x).alias("above"), calibration.gamma_tails(a - 0.5, x).alias("below"))
    above, whole, below = F.col("above"), F.col("whole"), F.col("below")
    between = F.when(x > 0, calibration.gamma_above(above, whole) & calibration.gamma_above(whole, below)).otherwise(above["upper"] + below["upper"] == 2)
    return tails.join(s.select("s_suppkey", "s_acctbal"), "s_suppkey").select("s_suppkey", F.round("whole.upper", 9).alias("whole"), between.alias("between"))


QUERIES = {f.__name__: f for f in (gamma_tails, walk_horizons, stream_learner, stream_session, stream_dedupe, pchip_grid, revenue_band, pit_uniformity, pit_shape)}
QUERIES |= {"walk_forward": walk_forward_query, "peak_lag": peak_lag_query}

_KNOTS = """s as (select user_id, event_id as t, value as y, lead(event_id) over w - event_id as h, (lead(value) over w - value) / (lead(event_id) over w - event_id) as d
    from events where event_type = 'click' window w as (partition by user_id order by event_id)),
  n as (select *, lag(h) over w as h0, lag(d) over w as d0, lag(h, 2) over w as h00, lag(d, 2) over w as d00, lead(h) over w as h2, lead(d) over w as d2 from s window w as (partition by user_id order by t)),
  e as (select *, ((2 * h + h2) * d - h * d2) / (h + h2) as a, ((2 * h0 + h00) * d0 - h0 * d00) / (h0 + h00) as z from n),
  k as (select user_id, t, y, case
    when h0 is null and d2 is null then d when h0 is null then case when a * d <= 0 then 0 when d * d2 < 0 and abs(a) > 3 * abs(d) then 3 * d else a end
    when h is null and d00 is null then d0 when h is null then case when z * d0 <= 0 then 0 when d0 * d00 < 0 and abs(z) > 3 * abs(d0) then 3 * d0 else z end
    when d0 * d <= 0 then 0 else 3 * (h0 + h) / ((2 * h + h0) / d0 + (h + 2 * h0) / d) end as m from e)"""

# Averages of Legendre polynomials over tenths of -1 to 1, before they are scaled.
_MEANS = {1: "(2 * i + 1) / 10.0::double - 1", 2: "(((2 * i + 2) / 10.0::double - 1)**3 - ((2 * i + 2) / 10.0::double - 1) - ((2 * i) / 10.0::double - 1)**3 + ((2 * i) / 10.0::double - 1)) / 2 * 5", 3: "(5 * ((2 * i + 2) / 10.0::double - 1)**4 / 8 - 3 * ((2 * i + 2) / 10.0::double - 1)**2 / 4 - 5 * ((2 * i) / 10.0::double - 1)**4 / 8 + 3 * ((2 * i) / 10.0::double - 1)**2 / 4) * 5"}

ORACLE = {
    "gamma_tails": """select s_suppkey, round(case when s_acctbal <= 0 then 1 else exp(-s_acctbal / 500) * list_sum(list_transform(range(0, s_suppkey % 9 + 1), lambda k: pow(s_acctbal / 500, k) / gamma(k + 1))) end, 9)::double as whole, true as between from supplier""",
    "pit_shape": """with c as (select event_type, cast(least(9, greatest(0, floor(value / 150 * 10))) as integer) as b, count(*) as n from events group by 1, 2),
  f as (select t.event_type, b, coalesce(n, 0) as n from (select distinct event_type from events) t cross join range(10) r(b) left join c using (event_type, b)),
  m as (select i, """ + ", ".join(f"{v} as m{k}" for k, v in _MEANS.items()) + """ from range(10) t(i)),
  l as (select i, """ + ", ".join(f"m{k} / sqrt((select avg(m{k} * m{k}) from m)) as p{k}" for k in _MEANS) + """ from m),
  z as (select event_type, sum(n) as total, """ + ", ".join(f"sum(n * p{k}) / sqrt(sum(n)) as z{k}" for k in _MEANS) + """, 10 * sum(n * n) / sum(n) - sum(n) as chi from f join l on i = b group by 1)
  select event_type, chi < 16.918977604620448 as uniform, case when z1 * z1 + z2 * z2 + z3 * z3 < 7.814728 then 'calibrated'
    when abs(z1) > 1.959964 and z2 > greatest(1.959964, abs(z1) / 2) and abs(z3) > greatest(1.959964, abs(z1) / 2) and z1 * z3 > 0 then case when z1 > 0 then 'pinned-high' else 'pinned-low' end
    when abs(z1) > abs(z2) then case when z1 > 0 then 'biased-low' else 'biased-high' end when z2 > 0 then 'overconfident' else 'underconfident' end as shape from z""",
    "stream_session": """select user_id, min(ts) as start, max(ts) + interval 6 hours as "end", count(*) as n, round(sum(value), 4) as value from (
        select *, sum(case when ts < p + interval 6 hours then 0 else 1 end) over (partition by user_id order by ts) as i from (select *, lag(ts) over (partition by user_id order by ts) as p from events) a) b group by user_id, i""",
    "stream_dedupe": "select event_id, user_id, event_type, value from events",
    "pchip_grid": f"""with {_KNOTS}, g as (select user_id, event_id from events where event_type = 'view'),
        b as (select g.user_id, g.event_id, a.t as t0, a.y as y0, a.m as m0 from g asof left join k a on a.user_id = g.user_id and g.event_id >= a.t),
        c as (select b.*, k.t as t1, k.y as y1, k.m as m1 from b asof left join k on k.user_id = b.user_id and b.event_id <= k.t),
        x as (select *, (event_id - t0) / (t1 - t0) as x, t1 - t0 as w from c)
        select user_id, event_id, round(case when t0 is null then y1 when t1 is null then y0 else
          y0 * (2 * x * x * x - 3 * x * x + 1) + w * m0 * (x * x * x - 2 * x * x + x) + y1 * (3 * x * x - 2 * x * x * x) + w * m1 * (x * x * x - x * x) end, 5) as value from x""",
    "peak_lag": f"""with s as ({_STEPS}), l as (select unnest(range(-12, 13)) as lag),
        r as (select x.event_type, cast(l.lag as integer) as lag, abs(round(case when count(*) < 3 then 0 else coalesce(covar_pop(x.v, y.n) / nullif(stddev_pop(x.v) * stddev_pop(y.n), 0), 0) end, 6)) as r
          from s x, l, s y where y.event_type = x.event_type and y.step = x.step + l.lag group by 1, 2),
        p as (select *, row_number() over (partition by event_type order by r desc, lag) as i, max(r) over (partition by event_type) as hi, min(r) over (partition by event_type) as lo from r)
        select event_type, case when hi - lo >= 1e-4 and abs(lag) < 12 then lag end as lag, round(hi - lo, 5) as prominence, round(hi, 5) as strength from p where i = 1""",
    "revenue_band": """select event_id, round(e, 6) as expected, round(least(a, c), 6) as p10, round(greatest(a, c), 6) as p90, round(e / 100, 8) as per_mw from (
        select event_id, a, c, 0.3 * a + 0.4 * b + 0.3 * c as e from (select event_id, r * least(100, value * 0.5) as a, r * least(100, value) as b, r * least(100, value * 1.5) as c from (
        select event_id, value, 0.5 * (cast(json_extract_string(props, '$.k') as double) - 30) as r from events) x) y) z""",
    "pit_uniformity": """with c as (select event_type, cast(least(9, greatest(0, floor(value / 150 * 10))) as integer) as b, count(*) as n from events group by 1, 2),
        t as (select event_type, count(*) as total, avg(case when value / 150 between (1 - 0.8::double) / 2 and (1 + 0.8::double) / 2 then 1 else 0 end) as inside from events group by 1),
        f as (select t.event_type, total, inside, b, coalesce(n, 0) as n from t cross join range(10) r(b) left join c using (event_type, b))
        select event_type, round(sum((n - total / 10) * (n - total / 10) / (total / 10)), 4) as chi_squared,
          round(sum(n * case when b between 3 and 6 then 1 when b in (2, 7) then 0.5 else 0 end) / max(total), 6) as inside50,
          round(sum(n * case when b between 1 and 8 then 1 else 0 end) / max(total), 6) as inside80, round(max(inside), 6) as inside80_exactly,
          round(sum(case when b = 0 then n else 0 end) * 10 / max(total), 6) as first_bar from f group by 1""",
}
