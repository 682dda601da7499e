"""The explicit evaluation time used instead of the wall clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(as_of: Column | datetime | str) -> Column:
    """``as_of`` as a timestamp column (zone-free unless a Column is given)."""
    if isinstance(as_of, Column):
        return as_of
    text = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else as_of
    return F.to_timestamp_ntz(F.lit(text))


def days_before(as_of: Column | datetime | str, days: int) -> Column:
    """The moment ``days`` whole days before ``as_of``."""
    return moment(as_of) - F.make_dt_interval(F.lit(days))


def elapsed_days(as_of: Column | datetime | str, since: Column) -> Column:
    """Whole 24-hour periods between ``since`` and ``as_of`` (not calendar days)."""
    micros = F.unix_micros(moment(as_of).cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")
