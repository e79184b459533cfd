"""Nearest values: for each target, the neighbours of its place among the values of its key, and the snapshot that explains a bill best."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stages import staged


def between(rows: DataFrame, values: DataFrame, keys: Sequence[str], place: str, value: str, below: str, above: str) -> DataFrame:
    """``rows`` with ``below`` and ``above``: the rows of ``values`` (as structs without ``keys``) with the largest ``value`` at or
    below ``place`` of the same key, and with the smallest one beyond it; null where there is none.

    ``values`` has each value of a key once. Both sides are dealt by ranges of key and place and sorted, so a key, or a place,
    that most rows have is spread over tasks; the last value is carried forward, and each range begins with what the one before ended
    with. One pass, linear in both sides; it is written to the checkpoint folder, as ranges found again by sampling might differ.
    Null keys and places meet nothing; all rows stay.
    """
    own = F.struct(*(c for c in values.columns if c not in keys))
    known = values.where(F.col(value).isNotNull())
    marks = known.select(*keys, F.col(value).alias("__at"), own.alias("__own"))
    nothing = F.lit(None).cast(marks.schema["__own"].dataType)
    pair = lambda x, y: F.struct(x.alias("below"), y.alias("above")).alias("__pair")
    follow = F.lead("__own").over(Window.partitionBy(*keys).orderBy("__at"))
    # Before the first value of a key there is none below, and it is the one above.
    first = marks.groupBy(*keys).agg(F.min_by("__own", "__at").alias("__own")).select(*keys, F.lit(None).cast(marks.schema["__at"].dataType).alias("__at"), pair(nothing, F.col("__own")))
    held = first.unionByName(marks.select(*keys, "__at", pair(F.col("__own"), follow))).withColumns({"__side": F.lit(0), "__spread": F.lit(0).cast("bigint")})
    mine = rows.select(*keys, F.col(place).alias("__at"), F.lit(1).alias("__side"), F.xxhash64(*rows.columns).alias("__spread"), F.struct(*rows.columns).alias("__row"))
    both = mine.withColumn("__pair", F.lit(None).cast(held.schema["__pair"].dataType)).unionByName(held, allowMissingColumns=True)
    dealt = staged(both.repartitionByRange(*keys, "__at", "__side", "__spread").withColumn("__part", F.spark_partition_id()).drop("__spread"), "places")
    ends = dealt.groupBy("__part", *keys).agg(F.max(F.when(F.col("__side") == 0, F.struct("__at", "__pair"))).alias("__end"))
    # At most one row for each range: of its first key, if that began before.
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.withColumn("__before", before).where(F.col("__before").isNotNull()).select("__part", *keys, F.lit(-1).alias("__side"), F.col("__before.__pair").alias("__pair"))
    line = Window.partitionBy("__part", *keys).orderBy(F.col("__at").asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.unionByName(carried, allowMissingColumns=True).withColumn("__pair", F.last("__pair", ignorenulls=True).over(line)).where("__side = 1")
    meets = F.col("__at").isNotNull()
    for k in keys:
        meets &= F.col(k).isNotNull()
    return found.select("__row.*", F.when(meets, F.col("__pair.below")).alias(below), F.when(meets, F.col("__pair.above")).alias(above))


def bracket(targets: DataFrame, values: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Distinct (``keys``, ``at``) of ``targets`` with ``below``, the largest ``value`` at or below ``at`` of the same key, and
    ``above``, the smallest one beyond it; null where there is none. ``at`` and ``value`` are whole numbers.

    See ``between``. Targets with a null key or place, and those of keys without values, are left out.
    """
    held = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("bigint").alias("v")).distinct()
    points = targets.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("bigint").alias("t")).distinct()
    met = between(points, held, keys, "t", "v", "below", "above").where("below IS NOT NULL OR above IS NOT NULL")
    return met.select(*keys, F.col("t").alias(at), F.col("below.v").alias("below"), F.col("above.v").alias("above"))


def best_snapshot(bills: DataFrame, snapshots: DataFrame, ident: Sequence[str], component: str, amount: str, kwh: str, unit: str, value: str, since: str, scale: int = 4) -> DataFrame:
    """The snapshot of each bill's ``component`` whose estimate is closest to ``amount``: ``ident``, ``component``, ``unit``,
    ``value``, ``since``, estimate (to cents) and difference (amount less estimate, before rounding).

    An estimate is kwh times value by hundred where the unit is cents_per_kwh, the value itself where it is
    fixed_monthly; other units, null values and null dates take no part. Values have at most ``scale`` decimals. Of
    estimates as close the earliest date counts, then the lower value. Bills without positive kwh meet fixed charges
    only; bills with a null amount or component, or of a component without usable snapshots, have no row. Repeated
    bills stay. ``ident`` names the columns of the bills to keep.
    """
    per = float(10**scale)
    usable = snapshots.where(F.col(unit).isin("cents_per_kwh", "fixed_monthly") & F.col(value).isNotNull() & F.col(since).isNotNull())
    listed = usable.groupBy(F.col(component), F.col(unit), F.round(F.col(value) * per).cast("bigint").alias("v")).agg(F.min(since).alias(since))
    cents = F.when(F.col(kwh) > 0, F.floor(F.col(amount) * 100.0 / F.col(kwh) * per))
    asks = {"cents_per_kwh": cents, "fixed_monthly": F.floor(F.col(amount) * per)}
    rows = bills.where(F.col(component).isNotNull() & F.col(amount).isNotNull()).select(*ident, component, amount, kwh)
    tries = []
    for name, place in asks.items():
        sides = [f"__{side}_{name}" for side in ("below", "above")]
        rows = between(rows.withColumn("__t", place), listed.where(F.col(unit) == name).select(component, "v", since), [component], "__t", "v", *sides).drop("__t")
        for side in sides:
            exact = F.col(f"{side}.v") / per
            estimate = exact if name == "fixed_monthly" else F.col(kwh) * exact / 100.0
            order = F.abs(F.col(amount) - estimate).alias("off"), F.col(side)[since].alias("since"), exact.alias("value")
            tries.append(F.when(F.col(side).isNotNull(), F.struct(*order, F.lit(name).alias("unit"), estimate.alias("estimate"))))
    # Nulls are passed over.
    best = rows.select(*ident, component, amount, F.least(*tries).alias("b")).where("b IS NOT NULL")
    return best.select(
        *ident, component, F.col("b.unit").alias(unit), F.col("b.value").alias(value), F.col("b.since").alias(since),
        F.round("b.estimate", 2).alias("estimate"), (F.col(amount) - F.col("b.estimate")).alias("difference"),
    )
