"""Time expressions. Every instant is carried as epoch seconds or microseconds (bigint, UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Epoch values above this are milliseconds (in seconds it would be the year 5138).
MILLIS_FROM = 100_000_000_000


def iso_micros(text: Column) -> Column:
    """Epoch microseconds of an ISO-8601 string in any zone form; without a zone it is UTC. Malformed or null: null."""
    s = F.trim(text)
    zoned = F.when(s.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$"), s).otherwise(F.concat(s, F.lit("Z")))
    zoned = F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.unix_micros(zoned.try_cast("timestamp"))


def iso_seconds(text: Column) -> Column:
    """Epoch seconds, rounded down, of an ISO-8601 string."""
    return F.floor(iso_micros(text) / F.lit(1_000_000)).cast("bigint")


def wall_micros(stamp: Column) -> Column:
    """Epoch microseconds of a timestamp without zone, read as UTC whatever the session zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), stamp.cast("timestamp_ntz"))


def whole_seconds(ts: Column) -> Column:
    """Epoch seconds from a column that mixes seconds and milliseconds; milliseconds are cut off."""
    return F.when(F.abs(ts) > MILLIS_FROM, F.floor(ts / F.lit(1000)).cast("bigint")).otherwise(ts.cast("bigint"))


def ceil_seconds(micros: Column) -> Column:
    """The first whole second at or after an instant in microseconds."""
    return F.ceil(micros / F.lit(1_000_000)).cast("bigint")
