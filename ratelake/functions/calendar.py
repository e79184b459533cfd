"""Seasons, holidays and time-of-use periods as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months of each known season label, after normalisation.
SEASON_MONTHS = {
    "may-september": (5, 6, 7, 8, 9),
    "june-september": (6, 7, 8, 9),
    "july-september": (7, 8, 9),
    "july-october": (7, 8, 9, 10),
    "october-april": (1, 2, 3, 4, 10, 11, 12),
    "october-may": (1, 2, 3, 4, 5, 10, 11, 12),
    "october-june": (1, 2, 3, 4, 5, 6, 10, 11, 12),
    "november-june": (1, 2, 3, 4, 5, 6, 11, 12),
    "summer": (6, 7, 8, 9),
    "winter": (1, 2, 3, 4, 10, 11, 12),
}
#: Summer months of the structured engine, which differ from the label table.
ENGINE_SUMMER = (5, 6, 7, 8, 9)


def season_label(label: Column) -> Column:
    """Lower case, plain hyphens without spaces around them, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(label), "–—", "--"), r"\s*-\s*", "-"))


def season_matches(label: Column, month: Column) -> Column:
    """True if the month lies in the labelled season; also without a label, for unknown labels and for month 0."""
    name = season_label(label)
    known = F.lit(None).cast("boolean")
    for season, months in SEASON_MONTHS.items():
        known = F.when(name == season, month.isin(*months)).otherwise(known)
    return F.coalesce(F.when((label == "") | (month == 0), True).otherwise(known), F.lit(True))


def engine_season(day: Column) -> Column:
    """summer or winter as the structured engine sees it; null for a null date."""
    return F.when(F.month(day).isin(*ENGINE_SUMMER), "summer").when(day.isNotNull(), "winter")


def _observed(fixed: Column) -> Column:
    weekday = F.weekday(fixed)
    return F.when(weekday == 5, F.date_sub(fixed, 1)).when(weekday == 6, F.date_add(fixed, 1)).otherwise(fixed)


def _nth_weekday(first: Column, weekday: int, n: int) -> Column:
    """The nth ``weekday`` (0: Monday) of the month that begins at ``first``."""
    return F.date_add(first, F.pmod(weekday - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def holidays_of(year: Column) -> Column:
    """Array of the six observed holidays of a year. New Year's Day may be observed in the year before."""
    day = lambda month, d: F.make_date(year, F.lit(month), F.lit(d))
    end_of_may = day(5, 31)
    memorial = F.date_sub(end_of_may, F.weekday(end_of_may))
    return F.array(
        _observed(day(1, 1)), memorial, _observed(day(7, 4)), _nth_weekday(day(9, 1), 0, 1), _nth_weekday(day(11, 1), 3, 4), _observed(day(12, 25))
    )


def is_holiday(day: Column) -> Column:
    """Whether a date is among the observed holidays of its own calendar year."""
    return F.array_contains(holidays_of(F.year(day)), day)


def tou_period(local: Column) -> Column:
    """off_peak on weekends and holidays, else on_peak from 14 to 21 o'clock, discount from 21 to 6, off_peak between."""
    hour, day = F.hour(local), F.to_date(local)
    free = (F.weekday(day) >= 5) | is_holiday(day)
    return F.when(free, "off_peak").when((hour >= 21) | (hour < 6), "discount").when(hour >= 14, "on_peak").otherwise("off_peak")


def month_number(day: Column) -> Column:
    """Months since year 0, for gaps counted in months."""
    return F.year(day) * 12 + F.month(day)


def days_inclusive(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def overlap_days(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Days, ends included, that two date ranges share; 0 if none; null if a date is null."""
    first = F.when(start >= other_start, start).otherwise(other_start)
    last = F.when(end <= other_end, end).otherwise(other_end)
    return F.greatest(F.lit(0), F.datediff(last, first) + 1)
