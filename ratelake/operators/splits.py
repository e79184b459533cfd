"""Exact shares of every class: splits and folds by the rank of a hash, without sorting a class in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hex digits of a hash that make a bucket.
DIGITS = 4


def shares(rows: DataFrame, label: str, ident: str, ends: Sequence[float], seed: str = "", name: str = "part") -> DataFrame:
    """``rows`` with ``name``: the part that each falls into. Part i of a class holds its rows from rank round(ends[i - 1] n) to
    round(ends[i] n) by the hash of ``ident``; ends rise, and the last part goes to the end.

    A row's part depends on its own class only. Null labels are a class; rows of one id get neighbouring ranks. Counts of hash buckets tell the part
    of most rows; only rows of a bucket that a border falls into are ranked, bucket by bucket, so a class may hold any
    share of the rows.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident).cast("string"), F.lit(""))))
    hashed = rows.withColumns({"__h": digest, "__b": F.substring(digest, 1, DIGITS)})
    counts = hashed.groupBy(F.col(label).alias("__label"), F.col("__b").alias("__bucket")).agg(F.count("*").alias("__n"))
    # At most 16 ** DIGITS rows for each class.
    line = Window.partitionBy("__label").orderBy("__bucket")
    before = F.coalesce(F.sum("__n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumns({"__before": before, "__of": F.sum("__n").over(Window.partitionBy("__label"))})
    borders = F.array(*(F.floor(F.lit(float(e)) * F.col("__of") + 0.5) for e in ends))
    inside = F.exists("__borders", lambda b: (b > F.col("__before")) & (b < F.col("__before") + F.col("__n")))
    placed = placed.withColumn("__borders", borders).withColumn("__split", inside).drop("__of", "__n")
    met = hashed.join(placed, hashed[label].eqNullSafe(placed["__label"]) & (F.col("__b") == F.col("__bucket")))
    part = lambda rank: F.size(F.filter("__borders", lambda b: b <= rank))
    easy = met.where("NOT __split").withColumn(name, part(F.col("__before")))
    ranked = met.where("__split").withColumn("__rank", F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", ident)) - 1)
    hard = ranked.withColumn(name, part(F.col("__before") + F.col("__rank"))).drop("__rank")
    return easy.unionByName(hard).select(*rows.columns, name)


def stratified_split(rows: DataFrame, label: str, ident: str, fraction: float = 0.2, least: int = 5, seed: str = "split", name: str = "held_out") -> DataFrame:
    """``rows`` with ``name``: true for the exact share ``fraction`` (rounded half up) of each class, by hash rank. Classes with fewer than ``least`` rows
    are for training only."""
    sizes = rows.groupBy(F.col(label).alias("__class")).agg(F.count("*").alias("__size"))
    parted = shares(rows, label, ident, [fraction], seed, "__part")
    return parted.join(sizes, parted[label].eqNullSafe(sizes["__class"])).withColumn(name, (F.col("__part") == 0) & (F.col("__size") >= least)).select(*rows.columns, name)


def folds(rows: DataFrame, label: str, ident: str, k: int = 5, seed: str = "folds", name: str = "fold") -> DataFrame:
    """``rows`` with ``name``, 0 to k - 1: each class is cut into k parts whose sizes differ by one at most. Classes with fewer than k rows
    have null: they are learnt from in every fold and judge none."""
    sizes = rows.groupBy(F.col(label).alias("__class")).agg(F.count("*").alias("__size"))
    parted = shares(rows, label, ident, [(i + 1) / k for i in range(k - 1)], seed, "__part")
    fold = F.when(F.col("__size") >= k, F.col("__part"))
    return parted.join(sizes, parted[label].eqNullSafe(sizes["__class"])).withColumn(name, fold).select(*rows.columns, name)
