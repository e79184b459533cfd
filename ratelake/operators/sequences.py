"""Gaps, islands and running allocations along an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], starts: Column, name: str = "island") -> DataFrame:
    """Number of the streak each row lies in; a row where ``starts`` is true, or the first of its key, begins one.

    ``starts`` may look at the row before, through ``previous(column)``.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("__lag", F.lag(F.struct(*df.columns)).over(window))
    begins = F.when(F.col("__lag").isNull() | starts, 1).otherwise(0)
    running = F.sum("__begins").over(window.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("__begins", begins).withColumn(name, running).drop("__lag", "__begins")


def previous(column: str) -> Column:
    """The column in the row before, for ``islands``."""
    return F.col(f"__lag.{column}")


def gaps(df: DataFrame, keys: Sequence[str], day: str, least: int, tie: Sequence[str | Column] = ()) -> DataFrame:
    """Stretches of at least ``least`` days from one row's day to the next: keys, gap_start, gap_end, gap_days."""
    nxt = F.lead(day).over(Window.partitionBy(*keys).orderBy(day, *tie))
    out = df.where(F.col(day).isNotNull()).select(*keys, F.col(day).alias("gap_start"), nxt.alias("gap_end"))
    return out.withColumn("gap_days", F.datediff("gap_end", "gap_start")).where(F.col("gap_days") >= least)


def missing_numbers(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Whole numbers between the least and the largest of each key that no row has.

    Only neighbours with a hole between them make rows, so a long sequence without holes costs nothing.
    """
    held = df.where(F.col(number).isNotNull()).select(*keys, F.col(number).cast("bigint").alias("n")).distinct()
    pairs = held.withColumn("next", F.lead("n").over(Window.partitionBy(*keys).orderBy("n"))).where("next > n + 1")
    return pairs.select(*keys, F.explode(F.sequence(F.col("n") + 1, F.col("next") - 1)).alias("missing"))


def allocate_tiers(rows: DataFrame, keys: Sequence[str], quantity: str, low: str, high: str, offset: str | None = None, name: str = "tier_quantity") -> DataFrame:
    """How much of ``quantity`` falls into each tier of its key, tiers filled in order of ``low`` (open ends last).

    A tier takes at most its width, and what tiers before it have not taken. With ``offset``, the quantity starts
    that far up the ladder: a tier takes the overlap of [offset, offset + quantity] with [low, high].
    """
    lo, q = F.coalesce(F.col(low), F.lit(0.0)), F.col(quantity)
    if offset is not None:
        start = F.coalesce(F.col(offset), F.lit(0.0))
        end = F.when(F.col(high).isNull(), start + q).otherwise(F.least(F.col(high), start + q))
        return rows.withColumn(name, F.greatest(F.lit(0.0), end - F.greatest(lo, start)))
    width = F.when(F.col(high).isNull(), F.greatest(q - lo, F.lit(0.0))).otherwise(F.greatest(F.col(high) - lo, F.lit(0.0)))
    order = Window.partitionBy(*keys).orderBy(lo, F.col(high).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum("__width").over(order), F.lit(0.0))
    sized = rows.withColumn("__width", width)
    return sized.withColumn(name, F.least(F.col("__width"), F.greatest(q - taken, F.lit(0.0)))).drop("__width")


def running_cut(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], size: Column, most: int) -> DataFrame:
    """Leading rows of each key whose sizes add up to at most ``most``; the first is always kept."""
    window = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__sum", F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(window))
    return marked.where((F.col("__sum") <= most) | (F.col("__n") == 1)).drop("__sum", "__n")
