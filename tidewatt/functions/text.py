"""Names, codes and stamps, column to column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def normal_name(name: Column, words: list[str]) -> Column:
    """Upper case, up to the first `&`, without the given words and without anything but letters and digits."""
    head = F.substring_index(F.upper(name), "&", 1)
    return F.regexp_replace(F.regexp_replace(head, rf"\b({'|'.join(words)})\b", ""), "[^A-Z0-9]", "") if words else F.regexp_replace(head, "[^A-Z0-9]", "")


def without_unit_number(code: Column) -> Column:
    return F.regexp_replace(code, r"[_#-]?\d+$", "")


def contains_run(tokens: Column, needle: Column) -> Column:
    """Whether the tokens hold the needle's tokens one after another."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - F.size(needle) + 1))
    return (F.size(needle) > 0) & F.exists(starts, lambda i: F.slice(tokens, i, F.size(needle)) == needle)


def prefix_match(code: Column, station: Column) -> Column:
    """Whether a code is the station's id, alone or before an underscore or a digit."""
    rest = F.substring(code, F.length(station) + 1, F.lit(1))
    return F.startswith(code, station) & ((rest == "") | rest.rlike("[_0-9]"))


def number_or_null(value: Column) -> Column:
    return F.when(value.rlike(NUMERIC), F.expr("1.0D") * value.try_cast("double"))


def stamp_of(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d{12})", 1)


def fixed_offset(text: Column, hours: int = 10) -> Column:
    """UTC time of a stamp `yyyy/MM/dd HH:mm[:ss]` (space or T) in a zone of fixed offset; null if it can't be read."""
    clean = F.regexp_replace(F.replace(text, F.lit("T"), F.lit(" ")), "-", "/")
    padded = F.when(F.length(clean) == 16, F.concat(clean, F.lit(":00"))).otherwise(clean)
    return F.expr("interval 0 hours") + F.try_to_timestamp(padded, F.lit("yyyy/MM/dd HH:mm:ss")) - F.make_interval(hours=F.lit(hours))
