"""One row of each key, sets of keys, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_PLACE = "__place"


def first_of(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order, which should leave no ties. Spark drops others before the shuffle."""
    return top_of(df, keys, order, 1)


def top_of(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key, numbered in ``rank`` if it is named."""
    out = df.withColumn(_PLACE, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(_PLACE) <= n)
    return out.withColumnRenamed(_PLACE, rank) if rank else out.drop(_PLACE)


def keep_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Upsert: rows of both by key, the highest ``version`` wins, and of equal ones the new row."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return first_of(both, keys, [F.desc_nulls_last(version), F.desc("__new")]).drop("__new")


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``old`` and those of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def missing_from(wanted: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` whose key ``have`` lacks; null keys are equal to each other."""
    own = have.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return wanted.join(own, on, "left_anti")


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows, absent columns null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def duplicate_groups(df: DataFrame, content: Column, id_col: str) -> DataFrame:
    """Groups of rows with equal content: hash, size, smallest id and all ids. Groups are hashed before the shuffle."""
    marked = df.where(content.isNotNull()).select(F.sha2(content.cast("binary"), 256).alias("content_hash"), F.col(id_col).alias("id"))
    return (
        marked.groupBy("content_hash")
        .agg(F.count("*").alias("n_rows"), F.min("id").alias("first_id"), F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))
        .where("n_rows > 1")
    )
