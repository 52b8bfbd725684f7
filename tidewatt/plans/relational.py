"""Scans, filters, joins, set operations and top-k over the driver's tables.

Surrogates: supplier = unit, nation = station, region = region; a lineitem is a unit reading
(l_quantity = MW), events are a live stream of readings (user = station, type = fuel).
"""

from ._sql import both

_Q = {
    # Scans and predicates
    "scan_prune": "select l_orderkey, l_suppkey, l_quantity from lineitem where l_quantity >= 45 and l_returnflag = 'R'",
    "fleet_filter": "select c_custkey, c_nationkey, c_acctbal from customer where c_acctbal > 0 and c_mktsegment is not null",
    "training_mask": "select event_id, user_id, value from (select event_id, user_id, value, case when event_type = 'view' then null when value > 400 then true else false end as capped from events) t where capped = false and value > 0.5",
    "unit_convert": """select event_id, case when event_type = 'view' then value when event_type is not null then value * 60 / 5 else FAIL('unknown unit') end as mw,
        round(value * 60 / 5, 3) as mw_of_mwh from events""",
    "sign_by_type": "select l_orderkey, l_linenumber, case when l_linestatus = 'F' then -l_quantity else l_quantity end as signed_mw from lineitem",
    "band_flag": "select o_orderkey, o_totalprice, o_totalprice > 300000 or o_totalprice < 1000 as out_of_band from orders",
    "quality_case": """select event_id, case when abs(value) > 300 then 'suspect' when cnt < 60 then 'partial' else 'ok' end as quality
        from (select event_id, value, count(*) over (partition by user_id) as cnt from events) t""",
    "clip_capacity": "select c_custkey, least(greatest(c_acctbal, 0), 5000) as clipped from customer",
    "curtailed_mw": "select l_orderkey, l_linenumber, case when l_returnflag = 'A' then greatest(0, l_quantity - 25) end as curtailed_mw from lineitem",
    "json_props": "select event_id, JSON_K(props) as k from events",
    "target_choice": """select e.user_id, e.event_id, case when share >= 0.5 then e.value else -e.value end as target from events e
        join (select user_id, avg(case when value > 50 then DBL(1) else DBL(0) end) as share from events group by user_id) s on s.user_id = e.user_id""",
    "constant_target": "select user_id, count(distinct event_type) <= 1 as is_constant from events group by user_id",
    "length_gate": "select user_id, BIG(count(*)) as n from events group by user_id having count(*) >= 70",
    "under_fifty_null": "select user_id, case when count(*) < 65 then null else round(avg(value), 6) end as skill from events group by user_id",
    # Joins
    "unit_station_join": """select l_orderkey, l_linenumber, s_name, n_name, r_name from lineitem join supplier on s_suppkey = l_suppkey
        join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey where l_quantity > 48""",
    "unknown_units_anti": "select d.doc_id, d.source from documents d left join labels b on b.doc_id = d.doc_id where b.doc_id is null",
    "semi_units": "select s_suppkey, s_name from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity >= 50)",
    "longest_prefix": """with kinds as (select distinct substring(p_type, 1, 5) as kind from part union select distinct substring(p_type, 1, 8) from part)
        select p_partkey, kind from (
        select p_partkey, k.kind, row_number() over (partition by p_partkey order by length(k.kind) desc, k.kind) as rn
        from (select p_partkey, substring(p_type, 1, n) as head from part cross join (select distinct length(kind) as n from kinds) l) p
        join kinds k on k.kind = p.head) t where rn = 1""",
    "cascade_key": """select c_custkey, coalesce(a.s_name, b.s_name, d.n_name, 'none') as matched,
        case when a.s_name is not null then 1 when b.s_name is not null then 2 when d.n_name is not null then 3 end as attempt from customer
        left join (select s_suppkey, s_name from supplier where s_acctbal > 0) a on a.s_suppkey = c_custkey
        left join (select s_nationkey, min(s_name) as s_name from supplier where s_acctbal > 7000 group by s_nationkey) b on b.s_nationkey = c_nationkey
        left join (select n_nationkey, n_name from nation where n_regionkey < 3) d on d.n_nationkey = c_nationkey""",
    "effective_dated": """select o_custkey, o_orderkey, in_force from (
        select o_custkey, o_orderkey, in_force, row_number() over (partition by o_custkey order by case when in_force then 1 else 0 end desc, starts desc, o_orderkey) as rn from (
        select o_custkey, o_orderkey, starts, starts <= cast('1997-01-01' as date) and DAYS(starts, 30 + o_orderkey % 400) > cast('1997-01-01' as date) as in_force
        from (select o_custkey, o_orderkey, cast(o_orderdate as date) as starts from orders) x) y) t where rn = 1""",
    "price_join_audit": """select h.event_type, BIG(count(*)) as n, BIG(sum(case when p.price is null then 1 else 0 end)) as unpriced from events h
        left join (select TRUNC('hour', ts) as hour, event_type, avg(value) as price from events group by 1, 2 having count(*) >= 3) p
          on p.hour = TRUNC('hour', h.ts) and p.event_type = h.event_type group by h.event_type""",
    "two_instant_merge": """select user_id, slot, sum(actual) as actual, sum(target) as target from (
        select user_id, BIG(floor(EPOCH(ts) / 300)) * 300 - 300 as slot, value as actual, null as target from events
        union all select user_id, BIG(floor(EPOCH(ts) / 300)) * 300, null, value * 2 from events) t group by user_id, slot""",
    "precedence_full_join": """select coalesce(a.k, b.k) as k, coalesce(a.v, b.v) as v from (select c_custkey as k, c_acctbal as v from customer where c_nationkey < 15) a
        full join (select c_custkey as k, c_acctbal * 2 as v from customer where c_nationkey > 5) b on a.k = b.k""",
    "offset_reconcile": """select a.at, round(sum(a.v), 6) as now_mw, round(sum(b.v), 6) as before_mw from
        (select BIG(floor(EPOCH(ts) / 3600)) as at, sum(value) as v from events group by 1) a
        join (select BIG(floor(EPOCH(ts) / 3600)) as at, sum(value) as v from events group by 1) b on b.at = a.at - 1 group by a.at""",
    "forecast_outcome": """select f.event_id, f.user_id, round(abs(f.value - o.actual), 6) as error from
        (select event_id, user_id, value, BIG(floor(EPOCH(ts) / 3600)) + 24 as due from events) f
        join (select user_id, BIG(floor(EPOCH(ts) / 3600)) as at, avg(value) as actual from events where value <= 400 group by 1, 2) o
          on o.user_id = f.user_id and o.at = f.due""",
    "caps_bool_or": "select n_name, bool_or(s_acctbal < 0) as capped from supplier join nation on n_nationkey = s_nationkey group by n_name",
    "history_anti": """select event_id, user_id from events e where event_type <> 'view' and not exists (
        select 1 from events h where h.event_type = 'view' and h.user_id = e.user_id and TRUNC('day', h.ts) = TRUNC('day', e.ts))""",
    "cross_small": "select r_name, n_name from region, nation where n_regionkey <> r_regionkey",
    "curve_lookup": "select n_name, c_custkey, coalesce(c_acctbal, 0) as gain from nation left join customer on c_nationkey = n_nationkey and c_acctbal > 9000",
    # Sorts, limits, top-k
    "rank_signals": "select o_orderkey, o_totalprice from orders order by abs(o_totalprice) desc, o_orderkey limit 20",
    "topn_per_class": """select event_type, event_id, value from (select event_type, event_id, value, row_number() over (partition by event_type order by value desc, event_id) as rn from events) t where rn <= 27""",
    "latest_days": "select event_id from events where cast(ts as date) in (select d from (select distinct cast(ts as date) as d from events order by d desc limit 7) t)",
    "newest_name": "select max(p_name) as newest from part",
    "largest_station": "select s_suppkey, s_acctbal from supplier order by s_acctbal desc, s_suppkey limit 1",
    "nulls_last_board": "select c_custkey, case when c_acctbal < 0 then null else c_acctbal end as skill from customer order by skill desc nulls last, c_custkey limit 2000",
    # Set operations
    "union_sources": "select n_nationkey as k, 'nation' as kind from nation union all select r_regionkey, 'region' from region",
    "except_days": "select distinct cast(o_orderdate as date) as d from orders except select distinct cast(l_shipdate as date) from lineitem",
    "intersect_days": "select c_nationkey as k from customer intersect select s_nationkey from supplier",
    "union_ids": "select s_suppkey as id from supplier union select c_custkey from customer",
    "distinct_fuels": "select distinct event_type from events",
}

QUERIES, ORACLE = both(_Q)
