"""Reconciling two lists, rules that give several findings, ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(actual: DataFrame, estimated: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Keys of either side with both amounts, their difference and matched, actual_only or estimated_only.

    Rows of one key are added up first, so nothing multiplies.
    """
    a = actual.groupBy(*keys).agg(F.sum(amount).alias("actual_amount"), F.lit(True).alias("__a"))
    e = estimated.groupBy(*keys).agg(F.sum(amount).alias("estimated_amount"), F.lit(True).alias("__e"))
    both = a.join(e, list(keys), "full_outer")
    state = F.when(F.col("__a") & F.col("__e"), "matched").when(F.col("__a"), "actual_only").otherwise("estimated_only")
    delta = F.coalesce("estimated_amount", F.lit(0.0)) - F.coalesce("actual_amount", F.lit(0.0))
    return both.select(*keys, "actual_amount", "estimated_amount", state.alias("status"), delta.alias("delta"))


def accuracy_band(delta: Column) -> Column:
    """good_match up to 1 dollar, close_match up to 2.50, else review."""
    return F.when(F.abs(delta) <= 1.0, "good_match").when(F.abs(delta) <= 2.5, "close_match").otherwise("review")


def findings(df: DataFrame, rules: dict[str, Column], *keep: str, name: str = "finding") -> DataFrame:
    """A row for each rule that holds, in one pass over the data."""
    held = F.array_compact(F.array(*(F.when(rule, F.lit(rule_name)) for rule_name, rule in rules.items())))
    return df.select(*keep, F.explode(held).alias(name))


def score(*parts: tuple[Column, Column | float]) -> Column:
    """Sum of the points of the conditions that hold; unknown conditions do not."""
    total = F.lit(0.0)
    for holds, points in parts:
        total = total + F.when(holds, points).otherwise(0.0)
    return total


def band(value: Column, high: float, medium: float) -> Column:
    return F.when(value >= high, "high").when(value >= medium, "medium").otherwise("low")


def range_sum(points: DataFrame, ranges: DataFrame, keys: Sequence[str], day: str, start: str, end: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the days of each range, ends included, by key; null where a range has no points.

    Points are added up by day, and ranges are opened into their days, so that the join is by equality and a
    hot key spreads over its days.
    """
    daily = points.groupBy(*keys, F.col(day).alias("__day")).agg(F.sum(value).alias("__value"))
    days = ranges.where(F.col(end) >= F.col(start)).withColumn("__day", F.explode(F.sequence(F.col(start), F.col(end))))
    summed = days.join(daily, [*keys, "__day"], "left").groupBy(*ranges.columns).agg(F.sum("__value").alias(name))
    return summed


def quartile_outliers(df: DataFrame, keys: Sequence[str], value: str, factor: float = 3.0, least: int = 3) -> DataFrame:
    """Rows outside the quartiles by ``factor`` spreads, quartiles taken by position without interpolation.

    Position is floor(n / 4) and floor(3 n / 4) in sorted order; a spread of 0 counts as 1; groups smaller than
    ``least`` have no outliers. Rows are numbered per key; the quartiles join back as one row for each key.
    """
    from pyspark.sql.window import Window

    rows = df.where(F.col(value).isNotNull())
    numbered = rows.select(*keys, value, F.row_number().over(Window.partitionBy(*keys).orderBy(value)).alias("__i"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    at = lambda share: F.max(F.when(F.col("__i") == F.floor(F.col("__n") * share) + 1, F.col(value)))
    quartiles = numbered.join(sizes, list(keys)).groupBy(*keys).agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    spread = F.when(F.col("q3") == F.col("q1"), 1.0).otherwise(F.col("q3") - F.col("q1"))
    out = rows.join(quartiles, list(keys))
    return out.where((F.col(value) < F.col("q1") - factor * spread) | (F.col(value) > F.col("q3") + factor * spread))
