"""Aggregations and ordered (window) operators."""

from ._sql import both

_MONEY = """select r_name, l_suppkey, l_quantity as mw, l_extendedprice / l_quantity / 1000 - 1 as rrp, l_quantity * 5 / 60 as mwh
  from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey"""

_Q = {
    "region_revenue": f"""select r_name, BIG(count(*)) as intervals, BIG(count(distinct l_suppkey)) as units, round(sum(mwh), 4) as energy_mwh, round(sum(mwh * rrp), 4) as revenue,
        round(avg(rrp), 6) as mean_rrp, round(sum(mwh * rrp) / nullif(sum(mwh), 0), 6) as captured_price,
        BIG(sum(case when rrp < 0 then 1 else 0 end)) as negative_intervals, round(sum(case when rrp < 0 then mwh * rrp else 0 end), 4) as negative_revenue
        from ({_MONEY}) t group by r_name""",
    "station_revenue": f"""select l_suppkey, round(sum(mwh * rrp), 4) as revenue, round(sum(mwh), 4) as energy_mwh, round(sum(mwh * rrp) / nullif(sum(mwh), 0), 6) as captured_price,
        BIG(sum(case when rrp < 0 then 1 else 0 end)) as negative_intervals, BIG(count(rrp)) as priced from ({_MONEY}) t group by l_suppkey""",
    "curtailment_split": """select l_suppkey, reason, round(sum(mwh), 4) as mwh, round(sum(case when rrp >= 0 then mwh * rrp else 0 end), 4) as lost, round(sum(case when rrp < 0 then -mwh * rrp else 0 end), 4) as saved,
        round(sum(case when rrp >= 0 then mwh * rrp else mwh * rrp end), 4) as net from (
        select l_suppkey, rrp, greatest(0, l_quantity - 30) * 5 / 60 as mwh, case when rrp < 0 then 'negative_price' when l_returnflag = 'R' then 'dispatch_cap' when l_returnflag = 'A' then 'unexplained' else 'unknown' end as reason
        from (select *, l_extendedprice / l_quantity / 1000 - 1 as rrp from lineitem) x where l_quantity > 30) t group by l_suppkey, reason""",
    "station_interval": "select user_id, BIG(floor(EPOCH(ts) / 300)) * 300 - 300 as at, round(sum(value), 4) as output_mw, BIG(count(distinct event_type)) as units, BIG(sum(case when abs(value) > 1 then 1 else 0 end)) as online from events group by 1, 2",
    "binding_run": """select user_id, day, event_id, value, run from (
        select user_id, TRUNC('day', ts) as day, event_id, value, JSON_K(props) as run,
        row_number() over (partition by user_id, TRUNC('day', ts) order by JSON_K(props) desc, event_id) as rn from events) t where rn = 1""",
    "interval_reset": "select event_id, hour from (select event_id, TRUNC('hour', ts) as hour, JSON_K(props) as run, max(JSON_K(props)) over (partition by TRUNC('hour', ts)) as newest from events) t where run = newest",
    "price_summary": """select event_type, BIG(count(*)) as n, round(avg(value), 6) as mean, round(QUANTILE(value, 0.5), 6) as median, round(QUANTILE(value, 0.05), 6) as p5, round(QUANTILE(value, 0.95), 6) as p95,
        min(value) as lowest, max(value) as highest, BIG(sum(case when value < 1 then 1 else 0 end)) as n_low, BIG(sum(case when value > 300 then 1 else 0 end)) as n_high from events group by event_type""",
    "region_bucket": "select n_regionkey, l_linestatus, round(sum(greatest(0, l_quantity - 10)), 4) as mw from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey where l_returnflag <> 'N' group by n_regionkey, l_linestatus",
    "reconcile_worst": "select max_by(n_regionkey, d) as worst_region, round(max(d), 6) as worst_pct from (select n_regionkey, abs(coalesce((sum(s_acctbal) - avg(s_acctbal)) / nullif(sum(s_acctbal), 0), 0)) * 100 as d from supplier join nation on n_nationkey = s_nationkey group by n_regionkey) t",
    "fleet_rollup": "select TRUNC('day', ts) as day, event_type, round(sum(value), 4) as mw, bool_and(value > 0) as complete from events group by grouping sets ((TRUNC('day', ts)), (TRUNC('day', ts), event_type))",
    "cube_rollup": "select l_returnflag, l_linestatus, BIG(count(*)) as n, round(sum(l_quantity), 2) as mw from lineitem group by cube (l_returnflag, l_linestatus)",
    "weighted_mean": "select c_nationkey, round(sum(c_acctbal * c_custkey) / sum(c_custkey), 6) as weighted from customer group by c_nationkey",
    "upper_median": """select event_type, value as upper_median from (select event_type, value, row_number() over (partition by event_type order by value) as rn, count(*) over (partition by event_type) as n from events) t
        where rn = BIG(floor(n / DBL(2))) + 1""",
    "pearson_safe": """select user_id, case when count(*) < 3 then 0 else round(coalesce(covar_pop(value, event_id) / nullif(stddev_pop(value) * stddev_pop(event_id), 0), 0), 6) end as r
        from events group by user_id""",
    "spearman": """select event_type, round(coalesce(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 0), 6) as rho from (
        select event_type, rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / DBL(2) as rx,
        rank() over (partition by event_type order by JSON_K(props)) + (count(*) over (partition by event_type, JSON_K(props)) - 1) / DBL(2) as ry from events) t group by event_type""",
    "average_rank": "select event_id, rank() over (partition by event_type order by JSON_K(props)) + (count(*) over (partition by event_type, JSON_K(props)) - 1) / DBL(2) as avg_rank from events",
    "mutual_information": """select round(sum(p * ln(p / (px * py)) / ln(DBL(2))), 6) as bits from (
        select n / total as p, sum(n) over (partition by bx) / total as px, sum(n) over (partition by by_) / total as py from (
        select bx, by_, DBL(count(*)) as n, max(total) as total from (
        select least(19, floor((value - lo) / (hi - lo) * 20)) as bx, least(19, floor((DBL(JSON_K(props)) - klo) / (khi - klo) * 20)) as by_, DBL(cnt) as total from events
        cross join (select min(value) as lo, max(value) as hi, min(DBL(JSON_K(props))) as klo, max(DBL(JSON_K(props))) as khi, count(*) as cnt from events) x) b
        group by bx, by_) c) d""",
    "masked_fraction": "select user_id, round(avg(case when value > 100 then DBL(1) else DBL(0) end), 6) as masked from events group by user_id",
    "completeness": "select cast(ts as date) as day, BIG(count(distinct BIG(floor(EPOCH(ts) / 300)))) as stamps, count(distinct BIG(floor(EPOCH(ts) / 300))) = 288 as complete from events group by 1",
    "pit_bins": "select bin, BIG(count(*)) as n from (select greatest(0, least(9, BIG(floor(pit * 10)))) as bin from (select percent_rank() over (partition by event_type order by value, event_id) as pit from events) a) b group by bin",
    "region_share": "select n_regionkey, round(v, 4) as v, round(v / sum(v) over (), 6) as share from (select n_regionkey, sum(s_acctbal) as v from supplier join nation on n_nationkey = s_nationkey group by n_regionkey) t",
    "climatology": "select user_id, cast(extract(hour from ts) * 2 + floor(extract(minute from ts) / 30) as bigint) as cell, round(avg(value), 6) as mean, BIG(count(*)) as n from events group by 1, 2",
    "mean_across_regions": "select TRUNC('hour', ts) as hour, round(avg(price), 6) as price from (select TRUNC('hour', ts) as ts, event_type, avg(value) as price from events group by 1, 2) t group by 1",
    "errors_by_type": "select event_type, round(avg(abs(value - prev)), 6) as mae, round(sqrt(avg((value - prev) * (value - prev))), 6) as rmse, round(avg(case when value between prev - 50 and prev + 50 then DBL(1) else DBL(0) end), 6) as coverage from (select event_type, value, lag(value) over (partition by event_type order by event_id) as prev from events) t where prev is not null group by event_type",
    "skill_by_horizon": "select h, BIG(count(*)) as n, round(1 - avg(abs(v - m)) / nullif(avg(abs(v - f)), 0), 6) as skill from (select value as v, avg(value) over (partition by user_id order by event_id rows between 10 preceding and 1 preceding) as m, lag(value, 1) over (partition by user_id order by event_id) as f, event_type as h from events) t where m is not null and f is not null group by h",
    # Ordered operators
    "ramp_check": """select event_id, slot - prev_slot = 1 and abs(value - prev) > 200 as impossible from (
        select event_id, value, slot, lag(value) over (partition by event_type order by slot, event_id) as prev, lag(slot) over (partition by event_type order by slot, event_id) as prev_slot
        from (select event_id, event_type, value, BIG(floor(EPOCH(ts) / 300)) as slot from events) a) t where prev is not null""",
    "gap_islands": """select user_id, first_id, coalesce(next_id, last_id) as end_id, n from (
        select user_id, capped, first_id, last_id, n, lead(first_id) over (partition by user_id order by first_id) as next_id from (
        select user_id, island, capped, min(event_id) as first_id, max(event_id) as last_id, BIG(count(*)) as n from (
        select user_id, event_id, capped, sum(case when capped = prev then 0 else 1 end) over (partition by user_id order by event_id) as island from (
        select user_id, event_id, value > 60 as capped, lag(value > 60) over (partition by user_id order by event_id) as prev from events) a) b group by user_id, island, capped) c) d where capped""",
    "cum_revenue": "select event_id, round(sum(coalesce(value, 0)) over (partition by user_id order by event_id), 4) as cum from events",
    "stacked": "select hour, event_type, round(sum(v) over (partition by hour order by event_type), 4) as top from (select TRUNC('hour', ts) as hour, event_type, sum(value) as v from events group by 1, 2) t",
    "rolling_mean": "select event_id, round(avg(value) over (partition by user_id order by event_id rows between 3 preceding and current row), 6) as mean4 from events",
    "lags": "select event_id, coalesce(lag(value, 1) over w, first_value(value) over w) as lag1, coalesce(lag(value, 2) over w, first_value(value) over w) as lag2 from events window w as (partition by user_id order by event_id)",
    "persistence_h": "select event_id, value, lag(value, 6) over (partition by user_id order by event_id) as forecast from events",
    "ring288": "select event_id from (select event_id, row_number() over (partition by event_type order by event_id desc) as rn from events) t where rn <= 288",
    "trend_slope": """select event_id, case when n < 2 then 0 else round((n * sxy - sx * sy) / (n * sxx - sx * sx), 6) end as slope from (
        select event_id, DBL(count(*) over w) as n, sum(DBL(i)) over w as sx, sum(value) over w as sy, sum(i * value) over w as sxy, sum(DBL(i * i)) over w as sxx from (
        select event_id, user_id, value, row_number() over (partition by user_id order by event_id) as i from events) a
        window w as (partition by user_id order by event_id rows between 5 preceding and current row)) b""",
    "cutout_split": """select event_type, min_by(event_id, event_id) as split_id, BIG(max(score)) as score from (select event_type, event_id, score, max(score) over (partition by event_type) as best from (
        select event_type, event_id, sum(case when value > 50 then 1 else 0 end) over (partition by event_type order by event_id) +
        sum(case when value <= 50 then 1 else 0 end) over (partition by event_type order by event_id desc) as score from events) a) b where score = best group by event_type""",
    "stride_sample": """with views as (select event_id, value, BIG(floor(event_id / DBL(1024))) as part from events where event_type = 'view'),
        parts as (select part, m, coalesce(sum(m) over (order by part rows between unbounded preceding and 1 preceding), 0) as before from (select part, count(*) as m from views group by part) p)
        select event_id, value from (select v.event_id, v.value, before + row_number() over (partition by v.part order by v.event_id) as rn from views v join parts p on p.part = v.part) t
        cross join (select count(*) as n from views) x where (rn - 1) % greatest(1, BIG(ceil(n / DBL(500)))) = 0""",
    "grid_5min": "select event_type, SERIES(lo, hi) as slot from (select event_type, min(BIG(floor(EPOCH(ts) / 300))) as lo, max(BIG(floor(EPOCH(ts) / 300))) as hi from events group by event_type) t",
    "extents": "select user_id, min(value) as lo, max(value) as hi, max_by(value, event_id) as last_value from events group by user_id",
}

QUERIES, ORACLE = both(_Q)
