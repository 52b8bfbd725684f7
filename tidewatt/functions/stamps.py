"""File-safe names, days and clocks of instants, positions on a map: column to column.

Instants are seconds since 1970, so that no result depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a file name may hold as it is, though form encoding escapes it.
PLAIN = {"%21": "!", "%7E": "~", "%27": "'", "%28": "(", "%29": ")"}
DAY = 86_400


def safe_name(name: Column) -> Column:
    """A name that every file system takes, told apart from every other: percent encoding, the asterisk too."""
    out = F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for code, char in PLAIN.items():
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def named(safe: Column) -> Column:
    """The name that `safe_name` was given."""
    return F.url_decode(safe)


def stamp_before(stamp: Column, minutes: int = 5) -> Column:
    """The stamp `yyyyMMddHHmm` so many minutes earlier, in a zone without summer time; null where it can't be read."""
    at = F.try_to_timestamp(F.concat(stamp, F.lit("Z")), F.lit("yyyyMMddHHmmX"))
    moved = F.unix_timestamp(at) - 60 * minutes
    return F.concat(F.date_format(_date(moved), "yyyyMMdd"), _clock(moved, ""))


def day_of(at: Column) -> Column:
    """The UTC day as text, which sorts like the day."""
    return F.date_format(_date(at), "yyyy-MM-dd")


def day_start(day: Column) -> Column:
    """Seconds since 1970 at which a UTC day (yyyy-MM-dd) starts."""
    return F.unix_date(day.cast("date")).cast("long") * DAY


def year_day(at: Column) -> Column:
    return F.dayofyear(_date(at)).cast("long")


def day_minutes(at: Column) -> Column:
    """Minutes since midnight UTC, seconds as a fraction."""
    return F.pmod(at, F.lit(DAY)) / 60


def clock_label(at: Column, with_date: bool = False, hours: int = 10) -> Column:
    """`HH:mm`, or `dd Mon HH:mm`, in a zone of fixed offset."""
    local = at + 3600 * hours
    clock = _clock(local, ":")
    return F.concat_ws(" ", F.date_format(_date(local), "dd MMM"), clock) if with_date else clock


def _date(at: Column) -> Column:
    return F.date_from_unix_date(F.floor(at / DAY).cast("int"))


def _clock(at: Column, between: str) -> Column:
    minute = F.floor(F.pmod(at, F.lit(DAY)) / 60)
    parts = (F.floor(minute / 60), F.pmod(minute, F.lit(60)))
    return F.concat_ws(between, *[F.lpad(p.cast("string"), 2, "0") for p in parts])


def nearest_step(at: Column, seconds: int = 300) -> Column:
    """The multiple of `seconds` nearest to an instant, halves up."""
    return F.floor(at / seconds + 0.5) * seconds


def floor_quantile(ordered: Column, level: Column | float) -> Column:
    """Of an ascending array the element at floor(level * size), the last at most; null of an empty one."""
    level = level if isinstance(level, Column) else F.lit(level)
    return F.get(ordered, F.least(F.size(ordered) - 1, F.floor(level * F.size(ordered)).cast("int")))


def projected(lon: Column, lat: Column, box: tuple[float, float, float, float], span: float = 40.0) -> Column:
    """A point (x, y) on a flat map of width `span` whose middle is (0, 0); box is west, east, south, north; y grows to the south."""
    west, east, south, north = box
    x = (lon - west) / (east - west) - 0.5
    y = 0.5 - (lat - south) / (north - south)
    return F.struct((x * span).alias("x"), (y * span * (north - south) / (east - west)).alias("y"))
