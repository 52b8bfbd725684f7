"""Queries told in SQL that Spark and DuckDB both read, and the few spellings in which they differ."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: What the queries write in capitals: the spelling in Spark, in DuckDB.
SPELLINGS = {
    "EPOCH": ("unix_timestamp({0})", "cast(floor(epoch({0})) as bigint)"),
    "TRUNC": ("cast(date_trunc({0}, {1}) as timestamp_ntz)", "cast(date_trunc({0}, {1}) as timestamp)"),
    "QUANTILE": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "SERIES": ("explode(sequence({0}, {1}))", "unnest(generate_series({0}, {1}))"),
    "JSON_K": ("cast(get_json_object({0}, '$.k') as bigint)", "cast(json_extract_string({0}, '$.k') as bigint)"),
    "RX": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "DBL": ("cast({0} as double)", "cast({0} as double)"),
    "DAYS": ("date_add({0}, cast({1} as int))", "({0} + cast({1} as integer))"),
    "FAIL": ("cast(raise_error({0}) as double)", "cast(error({0}) as double)"),
    "BIG": ("cast({0} as bigint)", "cast({0} as bigint)"),
}


def _arguments(sql: str, start: int) -> tuple[list[str], int]:
    """The arguments of a call whose bracket opens before `start`, and where it ends."""
    parts, depth, quoted, at = [], 0, False, start
    for i in range(start, len(sql)):
        c = sql[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c == "(":
            depth += 1
        elif c == ")" and not depth:
            return [*parts, sql[at:i].strip()], i + 1
        elif c == ")":
            depth -= 1
        elif c == "," and not depth:
            parts.append(sql[at:i].strip())
            at = i + 1
    raise ValueError(f"a bracket is open in {sql!r}")


def spelled(sql: str, dialect: int) -> str:
    while m := re.search(rf"\b({'|'.join(SPELLINGS)})\(", sql):
        args, end = _arguments(sql, m.end())
        sql = sql[: m.start()] + SPELLINGS[m[1]][dialect].format(*args) + sql[end:]
    return sql


def spark_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that runs `sql` over the tables it names, read from a folder. Views are named by their folder, so that queries over
    several folders at the same time don't meet."""
    used = [t for t in TABLES if re.search(rf"\b(from|join|,)\s+{t}\b", sql)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tag = hashlib.md5(sf_dir.encode()).hexdigest()[:12]
        for name in used:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"{name}_{tag}")
        views = "with " + ", ".join(f"{name} as (select * from {name}_{tag})" for name in used)
        text = spelled(sql, 0).lstrip()
        return spark.sql(f"{views}, {text[5:]}" if text[:5].lower() == "with " else f"{views} {text}")

    return run


def both(queries: dict[str, str]) -> tuple[dict, dict]:
    """QUERIES and ORACLE of queries in shared SQL."""
    return {k: spark_query(v) for k, v in queries.items()}, {k: spelled(v, 1) for k, v in queries.items()}
