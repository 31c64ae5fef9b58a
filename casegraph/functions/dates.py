"""Dates as ISO strings of day, month or year precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_parts(date: Column) -> Column:
    """``y, m, d`` of an ISO date; a missing part is 0."""
    part = lambda i: F.coalesce(F.regexp_extract(date, r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?", i).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d"))


def iso_date(text: Column) -> Column:
    """ISO day of an ISO, compact or RFC 2822 date; empty if there is none."""
    iso = F.nullif(F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0), F.lit(""))
    compact = F.when(text.rlike(r"^\d{8}"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)))
    rfc = F.date_format(F.try_to_timestamp(F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), F.lit("d MMM yyyy")), "yyyy-MM-dd")
    return F.coalesce(iso, compact, rfc, F.lit(""))


def dates_compatible(a: Column, b: Column, days: int = 7, across_years: bool = False) -> Column:
    """Whether two ISO dates may mean one day: same year, wildcards for missing parts, within
    the window; with ``across_years``, two days within the window may be of different years."""
    one, two = date_parts(a), date_parts(b)
    gap = F.abs(F.datediff(F.try_to_date(b, "yyyy-MM-dd"), F.try_to_date(a, "yyyy-MM-dd")))
    both_days = (one["d"] > 0) & (two["d"] > 0)
    months = (one["m"] == 0) | (two["m"] == 0) | (one["m"] == two["m"])
    same_year = (one["y"] > 0) & (one["y"] == two["y"])
    if across_years:
        return F.when(both_days, gap <= days).otherwise(same_year & months)
    return same_year & F.when(both_days, gap <= days).otherwise(months)


def interval_low(date: Column) -> Column:
    """First day that an ISO day or month covers; null for a year."""
    month = F.try_to_date(F.concat(F.regexp_extract(date, r"^(\d{4}-\d{2})$", 1), F.lit("-01")), "yyyy-MM-dd")
    return F.coalesce(F.try_to_date(F.regexp_extract(date, r"^\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd"), month)


def interval_high(date: Column) -> Column:
    """Last day that an ISO day or month covers; null for a year."""
    return F.when(date.rlike(r"^\d{4}-\d{2}$"), F.last_day(interval_low(date))).otherwise(interval_low(date))


def earliest_day(dates: Column) -> Column:
    """Least date of day precision in an array."""
    return F.array_min(F.filter(dates, lambda d: d.rlike(r"^\d{4}-\d{2}-\d{2}")))


def sorted_days(dates: Column) -> Column:
    """Sorted distinct ISO days, the first of each item."""
    found = F.transform(dates, lambda d: F.regexp_extract(d, r"\d{4}-\d{2}-\d{2}", 0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda d: d != "")))


def period_label(period: Column) -> Column:
    """``30d`` as "30 days" and the like."""
    n, unit = F.regexp_extract(period, r"^(\d+)([dwmy])$", 1), F.regexp_extract(period, r"^(\d+)([dwmy])$", 2)
    name = F.element_at(F.create_map(*[F.lit(x) for x in ("d", "day", "w", "week", "m", "month", "y", "year")]), F.nullif(unit, F.lit("")))
    return F.when(n != "", F.concat(n, F.lit(" "), name, F.when(n == "1", F.lit("")).otherwise(F.lit("s")))).otherwise(period)


def recency_decay(day: Column, today: Column, half_life: float = 30.0) -> Column:
    """Half for every half-life of distance, one half without a date."""
    age = F.abs(F.datediff(today, day)).cast("double")
    return F.coalesce(F.pow(F.lit(0.5), age / F.lit(half_life)), F.lit(0.5))
