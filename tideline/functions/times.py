"""Times of day, dates in file names, and integer microseconds of zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Recognised placements of the date in file names.
DATE_TOKEN = r"(\d{4})-(\d{1,2})-(\d{1,2})"


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")


def from_micros(us: Column) -> Column:
    """Inverse of ``micros``."""
    days = F.floor(us / 86_400_000_000).cast("int")
    rest = us - days.cast("long") * 86_400_000_000
    return F.date_add(F.lit("1970-01-01").cast("date"), days).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (rest / F.lit(1_000_000)).cast("decimal(18,6)"))


def bucket(ts: str, width: str) -> Column:
    """Start of the ``width`` (such as ``1 second``) in which a zone-free timestamp lies."""
    return F.window(F.col(ts), width)["start"]


def clock_micros(text: Column) -> Column:
    """Microseconds of ``H:M:S[.f]``; the digits of ``f`` are a whole number of milliseconds (``.5`` is 5 ms); null if malformed."""
    part = lambda k: F.regexp_extract(text, r"^\s*(\d+):(\d+):(\d+)(?:\.(\d+))?\s*$", k).try_cast("long")
    return (part(1) * 3600 + part(2) * 60 + part(3)) * 1_000_000 + F.coalesce(part(4), F.lit(0)) * 1000


def name_date(name: Column) -> Column:
    """First ``yyyy-m-d`` in a file name as a date, else null."""
    part = lambda k: F.regexp_extract(name, DATE_TOKEN, k).try_cast("int")
    return F.try_make_timestamp_ntz(part(1), part(2), part(3), F.lit(0), F.lit(0), F.lit(0)).cast("date") if hasattr(F, "try_make_timestamp_ntz") else F.make_date(part(1), part(2), part(3))


def name_stem(path: Column) -> Column:
    """File name without folders and without anything from its first dot on."""
    return F.regexp_extract(path, r"([^/\\.]*)(?:\.[^/\\]*)?$", 1)


def wall_time(text: Column, zone: str | None = None) -> Column:
    """A time as text to a zone-free timestamp: one with an offset is brought to ``zone`` (the session's by default), others stand as they are; null if malformed."""
    there = F.current_timezone() if zone is None else F.lit(zone)
    offset = text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})\s*$")
    read = F.try_to_timestamp(text)
    return F.when(offset, F.convert_timezone(F.current_timezone(), there, read.cast("timestamp_ntz"))).otherwise(read.cast("timestamp_ntz"))
