"""Claims of regional fleets, newest files of a day, summaries of all days, and small scalar rules, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics, scores
from ..operators import signals
from ..sources import feeds

C = F.col


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fleet_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations of their nation's region, at two horizons, some without a curve."""
    s = _table(spark, sf_dir, "supplier").join(F.broadcast(_table(spark, sf_dir, "nation")), C("s_nationkey") == C("n_nationkey"))
    k, b = C("s_suppkey"), C("s_acctbal")
    claims = s.select(
        k.alias("station"), C("n_regionkey").alias("region"), F.explode(F.array(F.lit("1h"), F.lit("24h"))).alias("horizon"), (k % 7 + 1).cast("double").alias("capacity"), b.alias("mw"), (b / 2).alias("reference"),
        (b - 10).alias("lo"), (b + 10).alias("hi"), (0.8 + k % 3 / 20).alias("coverage"), (b / 10000).alias("skill"), (k % 4 / 4).alias("masked"), F.when(k % 3 == 0, b / 1e5).alias("curve_rmse"),
        (k * 3).alias("n"), (k * 100).alias("generated_at"), (k % 2 == 0).alias("constrained"), F.create_map(F.lit("a"), k % 5 / 5, F.lit("b"), 1 - k % 5 / 5).alias("weights"),
    )
    prices = _table(spark, sf_dir, "region").select(C("r_regionkey").alias("region"), (C("r_regionkey") * 10.0).alias("rrp"))
    out = signals.fleet_claims(claims, prices)
    rounded = [F.round(c, 6).alias(c) for c in ("capacity", "mw", "reference", "lo", "hi", "coverage", "skill", "masked", "curve_rmse", "price")]
    return out.select("region", "horizon", "stations", *rounded, "n", "generated_at", "constrained", F.round(C("weights")["a"], 6).alias("weight_a"))


def newest_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as published files: several a day, the last by name counts."""
    o = _table(spark, sf_dir, "orders")
    return feeds.newest_a_day(o.select(F.concat(F.lit("PUBLIC_NEXT_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.lpad(C("o_orderkey").cast("string"), 9, "0"), F.lit(".zip")).alias("name")))


def day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feeds.summary(_table(spark, sf_dir, "events"), "event_type", "value", {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "least", "greatest", "p5", "p50", "p95")])


def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped outputs with unknown capacities, a symmetric log taken back, and what prices are assumed to be."""
    b, k = C("s_acctbal"), C("s_suppkey")
    value = F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(b)
    capacity = F.when(k % 3 == 0, F.lit(None)).otherwise(F.lit(5000.0))
    told = scores.price_assumption(F.floor(b), F.when(k % 2 == 0, F.lit("contract")), F.when(k % 4 == 0, F.lit(30.0)))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", F.round(physics.clipped(value, capacity), 4).alias("clipped"), F.round(physics.symlog_inverse(physics.symlog(b)), 6).alias("back"), told["basis"].alias("basis"), told["minutes"].alias("minutes"))


QUERIES = {f.__name__: f for f in (fleet_claims, newest_a_day, day_summary, scalar_rules)}

ORACLE = {
    "fleet_claims": """with s as (select *, s_suppkey as k, s_acctbal as b, (s_suppkey % 7 + 1)::double as cap from supplier join nation on n_nationkey = s_nationkey, (values ('1h'), ('24h')) h(horizon))
  select n_regionkey as region, horizon, count(*) as stations, round(sum(cap), 6) as capacity, round(sum(b), 6) as mw, round(sum(b / 2), 6) as reference, round(sum(b - 10), 6) as lo, round(sum(b + 10), 6) as hi,
    round(min(0.8::double + k % 3 / 20.0::double), 6) as coverage, round(sum(b / 10000 * cap) / sum(cap), 6) as skill, round(sum(k % 4 / 4.0::double * cap) / sum(cap), 6) as masked,
    round(sum(b / 1e5 * cap) filter (k % 3 = 0) / sum(cap) filter (k % 3 = 0), 6) as curve_rmse, round(n_regionkey * 10.0::double, 6) as price, min(k * 3) as n, min(k * 100) as generated_at,
    coalesce(sum(cap) filter (k % 2 = 0), 0) > 0.5 * sum(cap) as constrained, round(sum(k % 5 / 5.0::double * cap) / sum(cap), 6) as weight_a from s group by 1, 2""",
    "newest_a_day": "select strftime(o_orderdate, '%Y%m%d') as day, max('PUBLIC_NEXT_' || strftime(o_orderdate, '%Y%m%d') || '_' || lpad(o_orderkey::varchar, 9, '0') || '.zip') as name from orders group by 1",
    "day_summary": "select event_type, count(value) as n, round(avg(value), 6) as mean, round(min(value), 6) as least, round(max(value), 6) as greatest, round(quantile_cont(value, 0.05), 6) as p5, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1",
    "scalar_rules": """select s_suppkey, round(case when s_suppkey % 5 = 0 then 0 when s_suppkey % 3 = 0 then greatest(0, s_acctbal) else least(5000, greatest(0, s_acctbal)) end, 4)::double as clipped, round(s_acctbal, 6)::double as back,
  case when s_suppkey % 2 = 0 then 'contract' else 'flat $' || cast(floor(s_acctbal) as bigint) || '/MWh across every forecast interval' end as basis, case when s_suppkey % 4 = 0 then 30.0 else 5.0 end::double as minutes from supplier""",
}
