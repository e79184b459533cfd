"""A Parquet table that is kept up to date by key, partition by partition, with counts of what changed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.operators.latest import first_of
from ratelake.operators.stages import staged


@dataclass(frozen=True)
class Upserted:
    """Rows of one call: inserted, updated, skipped (as they were) and rejected (without a key)."""

    inserted: int
    updated: int
    skipped: int
    rejected: int


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of both by key, with ``change``: inserted, updated, skipped (a new row equal to the old) or kept (no new row).

    Of new rows with one key the last in ``order`` counts. A row is equal if all columns are, nulls included. Rows
    without a full key are left out. Both sides have the same columns.
    """
    known = lambda df: df.dropna(subset=list(keys))
    latest = first_of(known(new), keys, [F.desc_nulls_last(c) for c in order])
    rest = [c for c in old.columns if c not in keys]
    a = known(old).select(*keys, F.struct(F.lit(1).alias("there"), *rest).alias("__old"))
    b = latest.select(*keys, F.struct(F.lit(1).alias("there"), *rest).alias("__new"))
    both = a.join(b, list(keys), "full")
    same = F.lit(True)
    for c in rest:
        same &= F.col(f"__old.{c}").eqNullSafe(F.col(f"__new.{c}"))
    change = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new").isNull(), "kept").when(same, "skipped").otherwise("updated")
    value = F.coalesce("__new", "__old")
    return both.select(*keys, *(value[c].alias(c) for c in rest), change.alias("change")).select(*old.columns, "change")


def upsert(new: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], partition: str) -> Upserted:
    """Bring the rows ``new`` into the table at ``path``; keys name at most one row each, in partitions by ``partition``, one of the keys.

    Only partitions in which a row was inserted or updated are written, each as a whole (dynamic overwrite); the rest keep
    their files. The merged rows are written to the checkpoint folder before, so the table is not read while it is
    written, and a call that is broken off can be made again: a second call with the same rows changes nothing. Counts are
    read from one column of what was written there. (An Observation on the write would spare that, but it leaves a manager in the session
    that Spark 4.1 cannot serialize, and models of Spark ML fail in that session from then on.)
    """
    if partition not in keys:
        raise ValueError("the partition must be part of the key, or a row could move and leave a copy behind")
    spark = new.sparkSession
    old = spark.read.schema(new.schema).parquet(path).select(*new.columns) if _exists(spark, path) else new.limit(0)
    rows = new.dropna(subset=list(keys))
    # Partitions without new rows are not read.
    near = old.join(rows.select(partition).distinct(), partition, "left_semi").select(*new.columns)
    n = lambda what: F.count_if(F.col("change") == what).alias(what)
    result = staged(merged(near, new, keys, order), "upsert")
    counts = result.agg(n("inserted"), n("updated"), n("skipped")).first()
    if counts["inserted"] + counts["updated"]:
        changed = result.where(F.col("change").isin("inserted", "updated")).select(partition).distinct()
        out = result.join(changed, partition, "left_semi").select(*new.columns)
        out.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    missing = F.lit(False)
    for k in keys:
        missing |= F.col(k).isNull()
    return Upserted(counts["inserted"], counts["updated"], counts["skipped"], new.where(missing).count())
