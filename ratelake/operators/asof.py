"""As-of joins: the last right row at or before each left row, by key.

Union and carry forward: one shuffle by key and one sort, linear in both sides, whatever the number of versions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .latest import first_of


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, tie: Sequence[str | Column] = (), *, inner: bool = False) -> DataFrame:
    """``left`` with the columns of the last row of ``right`` whose ``right_at`` is at or before ``left_at``.

    Of right rows at one time the last in ``tie`` order wins. Rows of ``left`` without one keep nulls, or go with
    ``inner``. Keys are compared by equality; left rows with a null key or time match nothing. Column names of
    the sides must differ but for the keys.
    """
    own = [c for c in right.columns if c not in keys]
    single = first_of(right.where(F.col(right_at).isNotNull()), [*keys, right_at], [F.col(t).desc() if isinstance(t, str) else t for t in tie] or [F.lit(1)])
    r = single.select(*keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.struct(*own).alias("__right"))
    nothing = F.lit(None).cast(r.schema["__right"].dataType)
    mine = left.select(*keys, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"))
    both = r.withColumn("__left", F.lit(None).cast(mine.schema["__left"].dataType)).unionByName(mine.withColumn("__right", nothing))
    order = Window.partitionBy(*keys).orderBy(F.col("__at").asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__last", F.last("__right", ignorenulls=True).over(order)).where("__side = 1")
    known = F.col("__at").isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    out = carried.select("__left.*", *(F.when(known, F.col(f"__last.{c}")).alias(c) for c in own))
    return out.where(F.col(right_at).isNotNull()) if inner else out


def carried_together(histories: Sequence[tuple[DataFrame, str, Sequence[str]]], keys: Sequence[str], at: str) -> DataFrame:
    """Every distinct (``keys``, ``at``) of several histories with the columns of each one's last row at or before it.

    A history is a DataFrame, its column of times and its order among rows of one time, of which the last wins. The histories meet by
    key once, whatever their number: rows of one key and time become one, and each history is carried forward over these. Names
    must differ but for the keys. Null keys and times are kept, and match nothing.
    """
    parts, names = [], [f"__{i}" for i in range(len(histories))]
    for name, (rows, time, tie) in zip(names, histories, strict=True):
        own = F.struct(*(c for c in rows.columns if c not in keys))
        parts.append(rows.select(*keys, F.col(time).alias(at), F.struct(*tie, own.alias("own")).alias(name)))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    spine = both.repartition(*keys).groupBy(*keys, at).agg(*(F.max(n).alias(n) for n in names))
    line = Window.partitionBy(*keys).orderBy(F.col(at).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.col(at).isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    # Rows without a time come first and are not carried.
    last = {n: F.last(F.when(known, F.col(n)), ignorenulls=True).over(line) for n in names}
    out = spine.withColumns(last)
    return out.select(*keys, at, *(F.col(f"{n}.own.{c}").alias(c) for n, (rows, *_) in zip(names, histories, strict=True) for c in rows.columns if c not in keys))


def select_version(requests: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, start: str, order: Sequence[str | Column], approved: Column | None = None) -> DataFrame:
    """The version for each request: the latest that began at or before the date, else the earliest of all, else an undated one.

    Versions that are not ``approved`` count only where a key has no approved one. Of versions of one start, or without
    one, the first in ``order`` counts. Requests of keys without versions go; every other row and column of ``requests``
    is kept, repeated rows too. ``at`` and ``start`` are of one type.

    Versions become stretches of time that do not overlap, so each request meets one row of its key: an equality join
    with a range, which Spark broadcasts while versions are few and whose hot keys it can split.
    """
    usable = versions if approved is None else first_rank(versions, keys, F.when(approved, 0).otherwise(1))
    dated = F.col(start).isNotNull()
    usable = first_of(first_rank(usable, keys, F.when(dated, 0).otherwise(1)), [*keys, start], order)
    by_start = Window.partitionBy(*keys).orderBy(start)
    stretches = usable.withColumns({"__from": F.when(F.lag(start).over(by_start).isNotNull(), F.col(start)), "__until": F.lead(start).over(by_start)})
    own = [c for c in versions.columns if c not in keys]
    right = stretches.select(*(F.col(k).alias(f"__{k}") for k in keys), "__from", "__until", *own)
    day = F.col(at)
    met = F.coalesce(day >= F.col("__from"), F.col("__from").isNull()) & F.coalesce(day < F.col("__until"), F.col("__until").isNull() | (day.isNull() & F.col("__from").isNull()))
    for k in keys:
        met &= F.col(k) == F.col(f"__{k}")
    return requests.join(right, met).select(*requests.columns, *own)


def first_rank(df: DataFrame, keys: Sequence[str], rank: Column) -> DataFrame:
    """Rows with the lowest rank of their key: exact matches where there are any, else the next best."""
    best = F.min("__rank").over(Window.partitionBy(*keys))
    return df.withColumn("__rank", rank).withColumn("__best", best).where("__rank = __best").drop("__rank", "__best")


def coverage_status(at: Column, matched: Column) -> Column:
    """same_day, carried_forward or uncovered."""
    return F.when(matched.isNull(), "uncovered").when(matched == at, "same_day").otherwise("carried_forward")
