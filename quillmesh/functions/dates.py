"""Milliseconds since the epoch, UTC throughout."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Clocks further ahead than this are suspect and clamped.
MAX_DRIFT_MS = DAY_MS


def parse_date_ms(value: str) -> int:
    """Midnight UTC of a year-month-day with plain integers (no padding needed), 1970 to 9999."""
    m = re.fullmatch(r"\+?([0-9]+)-\+?([0-9]+)-\+?([0-9]+)", value)
    if not m:
        raise ValueError(f"not a date: {value}")
    year, month, day = map(int, m.groups())
    if not 1970 <= year <= 9999:
        raise ValueError(f"year out of range: {value}")
    return (datetime.date(year, month, day) - datetime.date(1970, 1, 1)).days * DAY_MS


def date_ms(value: Column) -> Column:
    """The same for a column; null where it is no date."""
    parts = F.regexp_extract(value, r"^([0-9]{1,4})-([0-9]{1,2})-([0-9]{1,2})$", 0)
    padded = F.concat_ws("-", *[F.lpad(F.regexp_extract(parts, r"^([0-9]+)-([0-9]+)-([0-9]+)$", i), n, "0") for i, n in ((1, 4), (2, 2), (3, 2))])
    ms = F.unix_millis(F.try_to_timestamp(padded, F.lit("yyyy-MM-dd")))
    return F.when(ms >= 0, ms)


def iso8601(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def file_stamp(created: Column) -> Column:
    """An ISO time as part of a file name."""
    return F.translate(F.substring(created, 1, 19), "T:-", "_")
