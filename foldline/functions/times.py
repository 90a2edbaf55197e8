"""Time expressions: tolerant parsing, folder labels, calendar slices.  Sessions run in UTC; wall-clock times stay as written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tried in order; a fraction of a second is optional wherever seconds are.
LAYOUTS = (
    "yyyy:MM:dd HH:mm:ss[.SSSSSSSSS]",
    "yyyy:MM:dd HH:mm:ss[.SSSSSSSSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]",
    "yyyy-MM-dd",
)
_SHAPES = (
    r"^\d{4}:\d\d:\d\d \d\d:\d\d:\d\d(\.\d+)?\z",
    r"^\d{4}:\d\d:\d\d \d\d:\d\d:\d\d(\.\d+)?[+-]\d\d:\d\d\z",
    r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z",
    r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d+)?\z",
    r"^\d{4}-\d\d-\d\d\z",
)
OFFSET = r"(Z|[+-]\d\d:\d\d)\z"


def strip_offset(x: Column) -> Column:
    """Without a trailing Z and all from the last plus or minus on."""
    short = F.regexp_replace(x, r"Z\z", "")
    return F.when(short.rlike("[+-]"), F.trim(F.regexp_replace(short, r"[+-][^+-]*\z", ""))).otherwise(short)


def parse_time(x: Column) -> Column:
    """The instant of the first layout that fits, naive times taken as UTC; null when none does or the year is before 1970."""
    x = F.trim(x)
    tries = [F.when(x.rlike(shape), F.try_to_timestamp(x, F.lit(layout))) for shape, layout in zip(_SHAPES, LAYOUTS, strict=True)]
    return _modern(F.coalesce(*tries), x)


def parse_wall(x: Column) -> Column:
    """The wall-clock time as written, whatever its offset."""
    x = F.trim(x)
    bare = F.when(x.rlike(r"\d:\d\d(\.\d+)?" + OFFSET), F.regexp_replace(F.regexp_replace(x, OFFSET, ""), "T", " ")).otherwise(x)
    return F.when(parse_time(x).isNotNull(), parse_time(bare))


def _modern(t: Column, x: Column) -> Column:
    """The year that counts is the one written."""
    return F.when(F.substring(x, 1, 4) >= "1970", t)


def first_time(*candidates: Column, parse=parse_time) -> Column:
    return F.coalesce(*(parse(c) for c in candidates))


def fixed_width(t: Column) -> Column:
    """Text whose order is the time's order, with nine decimals."""
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))


def month_folder(t: Column) -> Column:
    return F.concat(F.date_format(t, "yyyy"), F.lit("/"), F.date_format(t, "MM_MMMM"))


def span_label(start: Column, stop: Column) -> Column:
    """A day, a range of days in one month, or two named days."""
    same_day = F.to_date(start) == F.to_date(stop)
    same_month = F.trunc(start, "MM") == F.trunc(stop, "MM")
    return (
        F.when(same_day, F.date_format(start, "dd"))
        .when(same_month, F.concat_ws("-", F.date_format(start, "dd"), F.date_format(stop, "dd")))
        .otherwise(F.concat_ws("-", F.date_format(start, "MMM_dd"), F.date_format(stop, "MMM_dd")))
    )


def crosses_month(taken: Column, folder: Column) -> Column:
    return F.trunc(taken, "MM") != F.trunc(folder, "MM")


def day_label(taken: Column, folder: Column) -> Column:
    """Day of the month, or month and day where the folder's month is another."""
    return F.when(crosses_month(taken, folder), F.date_format(taken, "MMM_dd")).otherwise(F.date_format(taken, "dd"))


def bucket_start(t: Column, months: int) -> Column:
    """First day of the calendar slice of ``months`` months."""
    zero = F.month(t) - 1
    return F.make_date(F.year(t), (zero - zero % months + 1).cast("int"), F.lit(1))


def segment_label(start: Column, months: int) -> Column:
    if months >= 12:
        return F.date_format(start, "yyyy")
    return F.concat(F.date_format(start, "yyyy MMM"), F.lit("\u2013"), F.date_format(F.add_months(start, months - 1), "MMM"))


def auto_months(first, last) -> int:
    """Slices of half a year, or of a year where the span is over three years."""
    return 12 if (last - first).total_seconds() > 3 * 365 * 86400 else 6


def parse_day_range(name: str) -> tuple[int, int] | None:
    """(first, last) day of a folder named dd or dd_dd."""
    parts = name.split("_")
    if len(parts) > 2 or any(len(p) != 2 or not p.isascii() or not p.isdigit() or not 1 <= int(p) <= 31 for p in parts):
        return None
    return int(parts[0]), int(parts[-1])


def format_day_range(lo: int, hi: int) -> str:
    return f"{lo:02d}" if lo == hi else f"{lo:02d}_{hi:02d}"
