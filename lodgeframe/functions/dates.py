"""Dates of evaluation periods, stays and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_start(yyyymm: Column) -> Column:
    return F.to_date(F.concat(yyyymm.cast("string"), F.lit("01")), "yyyyMMdd")


def period_columns(yyyymm: Column) -> dict[str, Column]:
    """First and last day of a month given as yyyymm, as dates and in both text forms."""
    start = period_start(yyyymm)
    end = F.last_day(start)
    return {
        "date_start": start,
        "date_end": end,
        "date_start_str": F.date_format(start, "yyyy-MM-dd"),
        "date_end_str": F.date_format(end, "yyyy-MM-dd"),
        "date_start_yyyymmdd": F.date_format(start, "yyyyMMdd"),
        "date_end_yyyymmdd": F.date_format(end, "yyyyMMdd"),
    }


def overlaps(arrival: Column, departure: Column, start: Column, end: Column) -> Column:
    return (arrival <= end) & (departure >= start)


def not_ending_on_start(arrival: Column, departure: Column, start: Column) -> Column:
    """Stays that end on the window's first day have no night in it, unless same-day stays."""
    return (departure >= F.date_add(start, 1)) | ((arrival == start) & (departure == start))


def days_before(arrival: Column, start: Column) -> Column:
    return F.greatest(F.datediff(start, arrival), F.lit(0))


def days_after(departure: Column, end: Column) -> Column:
    return F.greatest(F.datediff(departure, F.date_add(end, 1)), F.lit(0))


def file_name_attributes(name: Column) -> dict[str, Column]:
    """Subject, date (yyyymmdd) and kind of a file named ``subject_date_...``.

    The date is digits or spelled like "May-31st-2025". A name without an
    underscore has none of the three; a date in neither form is null.
    """
    named = F.contains(name, F.lit("_"))
    parts = F.split(name, "_")
    text = F.get(parts, F.lit(1))
    plain = F.regexp_replace(text, r"(\d+)(st|nd|rd|th)", "$1")
    spelled = F.date_format(F.try_to_timestamp(plain, F.lit("MMMM-d-yyyy")), "yyyyMMdd")
    return {
        "data_subject": F.when(named, F.get(parts, F.lit(0))),
        "file_date": F.when(
            named, F.when(text.try_cast("bigint").isNotNull(), text).otherwise(spelled)
        ),
        "file_type": F.when(
            named,
            F.when(F.contains(name, F.lit("correction")), F.lit("correction")).otherwise(
                F.lit("daily")
            ),
        ),
    }


def stay_file_keys(name: Column) -> dict[str, Column]:
    """Keys in a file name of the form ``... (<prop_cd> stay_id <stay_id>)...``."""
    key = r"\((.+?) stay_id (\d+)\)"
    loose = F.regexp_extract(name, r"(?i)stay_id (\d+)", 1)
    return {
        "prop_cd": F.nullif(F.regexp_extract(name, key, 1), F.lit("")),
        "stay_id": F.when(loose != "", loose).otherwise(name),
    }
