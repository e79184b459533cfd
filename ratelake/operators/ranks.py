"""Places in an order without one task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stages import staged

#: monotonically_increasing_id has the partition in the bits above these.
_BITS = 33


def rank_in(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """``df`` with ``name``: each row's place (from 1) among the rows of its ``keys`` in ``order``, which should leave no ties.

    Rows are dealt by ranges of keys and order, so a key that holds most rows is spread over tasks; a row's place is its
    place in its range, plus the rows of the ranges before, less those of the keys before. The ranges are written once, as ranges found
    again by sampling might differ. Null keys are keys. What is broadcast is one row for each range.
    """
    at, part, start, place, first = (f"__{n}_{len(df.columns)}" for n in ("at", "part", "start", "place", "first"))
    by = [*(F.col(k).asc() for k in keys), *order]
    dealt = staged(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()), "ranks")
    dealt = dealt.withColumn(part, F.shiftrightunsigned(at, _BITS))
    counts = dealt.groupBy(part).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(part, F.coalesce(before, F.lit(0)).alias(start))
    placed = dealt.join(F.broadcast(starts), part).withColumn(place, F.col(start) + F.col(at).bitwiseAND(F.lit((1 << _BITS) - 1)))
    least = placed.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.min(place).alias(first))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return placed.join(least, same).select(*df.columns, (F.col(place) - F.col(first) + 1).alias(name))
