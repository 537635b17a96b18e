"""The three date formats that meet in an audit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(c: Column) -> Column:
    return F.try_to_date(c, "yyyy-MM-dd")


def dotted_date(c: Column) -> Column:
    return F.try_to_date(c, "dd.MM.yyyy")


def dotted_year(c: Column) -> Column:
    """Year of a dd.MM.yyyy text, NULL where the four characters are no number."""
    return F.substring(c, 7, 4).try_cast("int")


def local_date(c: Column, zone: str = "Europe/Istanbul") -> Column:
    """Calendar day, in `zone`, of an instant such as 2026-09-06T21:00:00.000+00:00, whatever the session's zone."""
    wall_clock = F.try_to_timestamp(c).cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit(zone), wall_clock).cast("date")
