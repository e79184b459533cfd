"""Coverage of time by versions: what is covered by none, by one or by several, from a sweep over starts and ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kinds of stretches and rows.
GAP, SINGLE, OVERLAP = "gap", "single", "overlap"
UNDATED, INVERTED = "undated_version", "inverted_version"


def stretches(versions: DataFrame, keys: Sequence[str], start: str, end: str, ident: str) -> DataFrame:
    """The time line of each key: ``keys``, kind (gap, single or overlap), starts, ends (inclusive, null if open), days,
    most (versions in effect at once), before (the version that ends where the stretch begins) and after (the one that
    begins where it ends).

    A version is in effect from ``start`` to ``end``, both included, or for ever without an end; days are dates. Of
    several versions before or after, the largest and the smallest ``ident``. Versions without a start, and those that end
    before they start, are not on the line (``flaws`` has them). Keys are compared by equality, null is a key as well.

    Starts and ends are added up by day before the sweep, so what one task sweeps is the days of a key, not its versions:
    a key with very many versions is summed where its rows are read.
    """
    rows = versions.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))
    begin = F.struct(F.col(start).alias("day"), F.lit(1).alias("change"), F.col(ident).alias("after"), F.lit(None).cast(dict(versions.dtypes)[ident]).alias("before"))
    stop = F.struct(F.date_add(end, 1).alias("day"), F.lit(-1).alias("change"), F.lit(None).cast(dict(versions.dtypes)[ident]).alias("after"), F.col(ident).alias("before"))
    events = rows.select(*keys, F.inline(F.when(F.col(end).isNull(), F.array(begin)).otherwise(F.array(begin, stop))))
    days = events.groupBy(*keys, "day").agg(F.sum("change").alias("change"), F.min("after").alias("after"), F.max("before").alias("before"))
    line = Window.partitionBy(*keys).orderBy("day")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    held = days.withColumn("n", F.sum("change").over(upto)).withColumn("kind", F.when(F.col("n") == 0, GAP).when(F.col("n") == 1, SINGLE).otherwise(OVERLAP))
    # Days on which one version takes over from another, or the number of overlapping ones changes, begin no stretch of their own.
    fresh = F.when(F.lag("kind").over(line) == F.col("kind"), 0).otherwise(1)
    marked = held.withColumns({"until": F.lead("day").over(line), "next": F.lead("after").over(line), "fresh": fresh})
    numbered = marked.withColumn("run", F.sum("fresh").over(upto))
    merged = numbered.groupBy(*keys, "run").agg(
        F.min("kind").alias("kind"), F.min("day").alias("starts"), F.max_by("until", "day").alias("until"), F.max("n").alias("most"),
        F.min_by("before", "day").alias("before"), F.max_by("next", "day").alias("after"),
    )
    # After the last end nothing is missing.
    return merged.where(~((F.col("kind") == GAP) & F.col("until").isNull())).select(
        *keys, "kind", "starts", F.date_sub("until", 1).alias("ends"), F.datediff("until", "starts").cast("bigint").alias("days"), "most", "before", "after"
    )


def flaws(versions: DataFrame, keys: Sequence[str], start: str, end: str, ident: str) -> DataFrame:
    """``keys``, kind and ``ident`` of versions without a start (undated_version) or with an end before it (inverted_version)."""
    kind = F.when(F.col(start).isNull(), UNDATED).when(F.col(end) < F.col(start), INVERTED)
    return versions.select(*keys, kind.alias("kind"), ident).where(F.col("kind").isNotNull())


def timeline_status(versions: DataFrame, keys: Sequence[str], start: str, end: str, ident: str) -> DataFrame:
    """One row for each key: versions, n_gaps, gap_days, n_overlaps, overlap_days (of those that end), undated, inverted and
    status: undated without any dated version, gaps_exist with a gap, overlaps_exist with an overlap, complete with
    neither and no flaw, else flawed."""
    counted = versions.groupBy(*keys).agg(
        F.count("*").alias("versions"), F.count_if(F.col(start).isNull()).alias("undated"), F.count_if(F.coalesce(F.col(end) < F.col(start), F.lit(False))).alias("inverted")
    )
    found = stretches(versions, keys, start, end, ident).groupBy(*keys).agg(
        F.count_if(F.col("kind") == GAP).alias("n_gaps"), F.coalesce(F.sum(F.when(F.col("kind") == GAP, F.col("days"))), F.lit(0)).alias("gap_days"),
        F.count_if(F.col("kind") == OVERLAP).alias("n_overlaps"), F.coalesce(F.sum(F.when(F.col("kind") == OVERLAP, F.col("days"))), F.lit(0)).alias("overlap_days"),
    )
    named = found.select(*(F.col(k).alias(f"__{k}") for k in keys), "n_gaps", "gap_days", "n_overlaps", "overlap_days")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = counted.join(named, same, "left").select(*keys, "versions", zero("n_gaps"), zero("gap_days"), zero("n_overlaps"), zero("overlap_days"), "undated", "inverted")
    status = F.when(F.col("versions") == F.col("undated"), "undated").when(F.col("n_gaps") > 0, "gaps_exist").when(F.col("n_overlaps") > 0, "overlaps_exist")
    return rows.withColumn("status", status.when(F.col("undated") + F.col("inverted") > 0, "flawed").otherwise("complete"))
