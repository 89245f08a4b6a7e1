"""Calendar arithmetic without a stored interval type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(c: Column) -> Column:
    """An ISO date or date and time (a final Z is fine) as a timestamp without zone; null where it is neither."""
    s = F.regexp_replace(F.trim(c), "Z$", "")
    iso = s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$")
    return F.when(iso, s.try_cast("timestamp_ntz"))


def add_calendar(c: Column, years: Column, months: Column, weeks: Column, days: Column, hours: Column | None = None) -> Column:
    """Years and months first, to the end of a shorter month; then the exact rest."""
    whole = F.add_months(c.cast("date"), (years * 12 + months).cast("int")).cast("timestamp_ntz")
    of_day = c - c.cast("date").cast("timestamp_ntz")
    rest = F.make_dt_interval((weeks * 7 + days).cast("int"), (hours if hours is not None else F.lit(0)).cast("int"))
    return whole + of_day + rest


def difference(a: Column, b: Column) -> tuple[Column, Column]:
    """Whole days and the remaining seconds between two times, whichever comes first."""
    seconds = F.abs(F.timestamp_diff("SECOND", a, b))
    return F.floor(seconds / 86400).cast("long"), (seconds % 86400).cast("long")


def human(a: Column, b: Column) -> Column:
    days, rest = difference(a, b)
    return F.concat(days.cast("string"), F.lit(" days, "), F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60))


def local_time(c: Column, offset: str = "+05:45") -> Column:
    """An instant in UTC as the wall clock of a fixed offset."""
    return F.convert_timezone(F.lit("UTC"), F.lit(offset), c)


def instant(gmt: Column, local: Column, offset_minutes: int = 345) -> Column:
    """The GMT stamp, or else the local one less the offset."""
    return F.coalesce(gmt, local - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(offset_minutes)))


def year_band(year: Column) -> Column:
    return F.when(year.isNull(), "unknown").when(year <= 2018, "<=2018").when(year == 2019, "2019").when(year <= 2022, "2020-2022").otherwise("2023-2026")
