"""Units, customer classes and labels of charges as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a class in a charge's label is called, first match wins.
LABEL_CLASSES = (
    ("small general service", "commercial_small"),
    ("medium general service", "commercial_medium"),
    ("large general service", "commercial_large"),
    ("general service", "commercial_small"),
    ("commercial_small", "commercial_small"),
    ("commercial_medium", "commercial_medium"),
    ("commercial_large", "commercial_large"),
    ("commercial", "commercial_small"),
    ("industrial", "industrial"),
    ("public authority", "industrial"),
    ("lighting", "lighting"),
    ("traffic signal", "traffic_signal"),
    ("seasonal", "seasonal_intermittent"),
    ("intermittent", "seasonal_intermittent"),
    ("residential", "residential"),
)
#: Classes of charges that also hold for a requested class.
CLASS_FALLBACKS = {
    "residential": ("secondary", "three_phase"),
    "general_service": ("primary", "secondary", "transmission", "unmetered", "three_phase"),
    "commercial": ("commercial_small", "commercial_medium", "commercial_large", "seasonal"),
    "commercial_small": ("commercial",),
    "commercial_medium": ("commercial",),
    "commercial_large": ("commercial",),
}


def cents(value: Column) -> Column:
    """Rounded to two places."""
    return F.round(value, 2)


def in_dollars(rate: Column, unit: Column) -> Column:
    """A rate in dollars: units with "cent" are hundredths."""
    return F.when(F.contains(F.lower(unit), F.lit("cent")), rate / 100).otherwise(rate)


def is_demand_unit(unit: Column) -> Column:
    """A unit per kW (or kVAr) and not per kWh; false for null."""
    low = F.lower(unit)
    return F.coalesce(F.contains(low, F.lit("kw")) & ~F.contains(low, F.lit("kwh")), F.lit(False))


def label_class(label: Column) -> Column:
    """The customer class that a charge's label speaks of, or null."""
    low = F.lower(label)
    return reduce(lambda out, pair: F.when(F.contains(low, F.lit(pair[0])), pair[1]).otherwise(out), reversed(LABEL_CLASSES), F.lit(None).cast("string"))


def class_matches(own: Column, requested: Column) -> Column:
    """True for no class, "all", the requested class, or one of its fallbacks."""
    near = reduce(lambda out, item: F.when(requested == item[0], own.isin(*item[1])).otherwise(out), CLASS_FALLBACKS.items(), F.lit(False))
    return F.coalesce((own == "") | (own == "all") | (own == requested) | near, F.lit(True))


def canonical_label(label: Column) -> Column:
    """Lower-case words joined by underscores."""
    return F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), F.lit("_"))


def present(value: Column) -> Column:
    """Not null, blank, "none" or "null"."""
    return F.coalesce(~F.lower(F.trim(value)).isin("", "none", "null"), F.lit(False))


def period_start(period: Column) -> Column:
    """First day of YYYY, YYYY-MM or YYYY-Qn; null otherwise."""
    month = F.coalesce(
        F.regexp_extract(period, r"^\d{4}-Q([1-4])$", 1).try_cast("int") * 3 - 2,
        F.regexp_extract(period, r"^\d{4}-(0[1-9]|1[0-2])$", 1).try_cast("int"),
        F.when(period.rlike(r"^\d{4}$"), 1),
    )
    return F.make_date(F.substring(period, 1, 4).try_cast("int"), month, F.lit(1))
