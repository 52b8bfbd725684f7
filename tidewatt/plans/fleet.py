"""The registry of stations, codes matched to stations, labels, parts of a day, arrays and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, scores
from ..operators.registry import match_codes, registry


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as units, nations as stations, half of which are found by name."""
    s, n = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    start = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("s_suppkey", F.lit(2000)).cast("int"))
    units = s.select(
        F.concat(F.lit("U"), F.floor(F.col("s_suppkey") / 2).cast("string")).alias("unit"), F.concat(F.lit("S"), F.col("s_nationkey")).alias("station"), F.concat(F.lit("R"), F.pmod("s_nationkey", F.lit(5))).alias("region"),
        F.when(F.pmod("s_suppkey", F.lit(7)) == 0, "LOAD").otherwise("GENERATOR").alias("dispatch"), F.lit("SCHEDULED").alias("schedule"), start.alias("start"), F.date_add(start, 900).alias("end"),
    )
    odd, key = F.pmod("n_nationkey", F.lit(2)) == 1, F.col("n_nationkey").cast("string")
    fuels = F.array(F.lit("wind"), F.lit("solar"), F.lit("coal"), F.lit("hydro"))
    facilities = n.select(
        F.concat(F.when(odd, "F").otherwise("S"), key).alias("code"), F.concat(F.col("n_name"), F.lit(" Wind Farm")).alias("name"), F.when(F.col("n_regionkey") == 4, "west").otherwise("east").alias("network"),
        F.lit(-30.0).alias("lat"), F.lit(140.0).alias("lon"), (F.col("n_nationkey") * 10.0).alias("capacity"),
        F.array(F.struct(F.get(fuels, F.pmod("n_nationkey", F.lit(4))).alias("fuel"), F.lit(10.0).alias("capacity")), F.struct(F.lit("gas").alias("fuel"), F.lit(5.0).alias("capacity"))).alias("units"),
    )
    names = n.select(F.concat(F.lit("S"), key).alias("station"), F.concat(F.col("n_name"), F.lit(" Power Station & others")).alias("name"))
    out = registry(units, names, facilities, F.lit("2023-01-01").cast("date"), limit=20)
    return out.select("station", "region", "network", "n_units", F.size("units").cast("long").alias("n_codes"), "found_by", "code", "fuel", "capacity", "modelled")


def code_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    facilities = p.select("p_partkey", F.concat(F.translate("p_name", " ", "_"), F.lit("_"), "p_type").alias("facility"))
    stations = p.select(F.explode(F.split("p_name", " ")).alias("code")).distinct().withColumn("battery", F.lit(False))
    found = match_codes(facilities.select("facility").distinct(), stations)
    return facilities.join(found.select("facility", "station"), "facility").select("p_partkey", "station")


def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("s_acctbal")
    return _table(spark, sf_dir, "supplier").select(
        "s_suppkey", labels.megawatts(b / 300).alias("mw"), labels.dollars(b).alias("dollars"), labels.percent(b / 10000).alias("percent"),
        labels.lag_label(F.floor(b / 500).cast("long")).alias("lag"), labels.fill("{who} owes {sum} {none}", {"who": F.col("s_name"), "sum": labels.dollars(b)}).alias("told"),
        labels.escaped(F.concat(F.lit("<"), F.col("s_name"), F.lit(">"))).alias("escaped"), labels.mixed_colour(F.lit("#000000"), F.lit("#fff"), b / 10000).alias("colour"),
        F.size(labels.price_ticks(F.lit(-50), b)).cast("long").alias("n_ticks"), F.round(labels.horizon_hours(F.lit("30min")), 3).alias("hours"),
    )


def day_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute of the day and month in a zone ten hours ahead, and the minute an hour later."""
    local = F.col("ts").cast("timestamp") + F.expr("interval 10 hours")
    minute = (F.hour(local) * 60 + F.minute(local)).cast("long")
    return _table(spark, sf_dir, "events").select("event_id", minute.alias("minute"), F.month(local).cast("long").alias("month"), F.pmod(minute + 60, F.lit(1440)).alias("later"))


def mark_to_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.round(scores.mark_to_market(F.col("value"), F.lit(80.0), F.get_json_object("props", "$.k").cast("double")), 4).alias("gain"))


def array_hofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's values in order: their running maximum's last step, the last three, every second."""
    held = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("a"))
    v = F.transform("a", lambda x: x["value"])
    return held.select(
        "user_id", F.array_position(v, F.array_max(v)).cast("long").alias("at"), F.round(F.aggregate(F.slice(v, F.greatest(F.lit(1), F.size(v) - 2), F.lit(3)), F.lit(0.0), lambda s, x: s + x), 4).alias("last3"),
        F.round(F.aggregate(F.filter(v, lambda x, i: i % 2 == 0), F.lit(0.0), lambda s, x: s + x), 4).alias("strided"),
    )


def map_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's counts by type as a map: one looked up with a default, merged with weights, its largest entry."""
    n = _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    held = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    weights = F.create_map(F.lit("view"), F.lit(0.5), F.lit("click"), F.lit(2.0))
    merged = F.map_zip_with("m", weights, lambda k, a, b: F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(1.0)))
    top = F.element_at(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))), 1)["k"]
    return held.select("user_id", F.coalesce(F.element_at("m", F.lit("purchase")), F.lit(0)).alias("purchases"), F.aggregate(F.map_values(merged), F.lit(0.0), lambda s, x: s + x).alias("weighted"), top.alias("top"))


QUERIES = {f.__name__: f for f in (registry_build, code_match, label_texts, day_parts, mark_to_market, array_hofs, map_ops)}

ORACLE = {
    "code_match": """with w as (select distinct unnest(string_split(p_name, ' ')) as code from part), f as (select p_partkey, '_' || replace(p_name, ' ', '_') || '_' || p_type || '_' as t from part)
        select p_partkey, code as station from (select p_partkey, code, row_number() over (partition by p_partkey order by length(code) desc, code) as i from f left join w on contains(t, '_' || code || '_')) x where i = 1""",
    "label_texts": """with d as (select *, case when s_acctbal < 0 then '-$' else '$' end || case when abs(s_acctbal) >= 10 then format('{:,}', cast(floor(abs(s_acctbal) + 0.5) as bigint)) else printf('%.2f', abs(s_acctbal)) end as dollars,
        cast(floor(s_acctbal / 500) as bigint) * 5 as minutes, lpad(lower(hex(cast(floor(255 * greatest(0, least(1, s_acctbal / 10000)) + 0.5) as bigint))), 2, '0') as c from supplier)
        select s_suppkey, case when abs(s_acctbal / 300) >= 10 then cast(cast(floor(s_acctbal / 300 + 0.5) as bigint) as varchar) else printf('%.1f', round(s_acctbal / 300, 1)) end as mw, dollars,
        cast(floor(s_acctbal / 10000 * 100 + 0.5) as bigint) || '%' as percent, case when minutes = 0 then 'peak at 0 min' when minutes > 0 then 'weather leads ' || minutes || ' min' else 'weather trails ' || -minutes || ' min' end as lag,
        s_name || ' owes ' || dollars || ' \u2014' as told, '&lt;' || s_name || '&gt;' as escaped, '#' || c || c || c as colour,
        len([t for t in [-1000, -100, -10, 0, 10, 100, 300, 1000, 5000, 17500] if t >= -50 and t <= s_acctbal]) as n_ticks, 0.5::double as hours from d""",
    "day_parts": "select event_id, m as minute, cast(month(l) as bigint) as month, (m + 60) % 1440 as later from (select event_id, l, cast(hour(l) * 60 + minute(l) as bigint) as m from (select event_id, ts + interval 10 hours as l from events) a) b",
    "mark_to_market": "select event_id, round(value * (80 - cast(json_extract_string(props, '$.k') as double)), 4) as gain from events",
    "array_hofs": """select user_id, list_position(v, list_max(v))::bigint as at, round(list_sum(v[-3:]), 4) as last3, round(list_sum(v[1:len(v):2]), 4) as strided from (select user_id, list(value order by event_id) as v from events group by 1) x""",
    "map_ops": """select user_id, sum(case when event_type = 'purchase' then n else 0 end)::bigint as purchases, sum(n * case event_type when 'view' then 0.5 when 'click' then 2 else 1 end)::double as weighted,
        min_by(event_type, event_type) filter (where i = 1) as top from (select *, row_number() over (partition by user_id order by n desc, event_type) as i from (select user_id, event_type, count(*) as n from events group by 1, 2) a) b group by 1""",
}
