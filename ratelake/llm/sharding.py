"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seed within each stratum (source), and a row's fractional rank is its place there over the
stratum's size. Sorted by fractional rank, every stretch of rows has the mixture of the whole, so the order is cut
into shards of equal counts. Places are found by range partitions and their counts: no window spans a stratum, and
a stratum or a text that makes up a third of all rows is split over tasks like any other. Only ids, sizes and
digests are moved. The seeded shuffle goes by the text before the id, so equal texts have neighbouring places in
their stratum and fall into one shard, or into neighbouring shards where the cut or the group's size demands it.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS, SEED = 8, "ratelake"
#: monotonically_increasing_id has the partition in the bits above these.
_BITS = 33


def _placed(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``place``: from 0 in the order of the columns ``order``, gapless. The rows are written once, as
    ranges that are found again by sampling might differ; what is broadcast is one row for each partition."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = common.materialize(dealt, label).withColumn("part", F.shiftrightunsigned("at", _BITS))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.col("at").bitwiseAND(F.lit((1 << _BITS) - 1))
    return dealt.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + inside).drop("at", "part", "start")


def _mixed(value: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit(""))))


def plan_shards(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source") -> DataFrame:
    """``id_col``, size (UTF-8 bytes of the text plus 1), text_crc32, text_md5, shard and slot, one row per input row.

    Counts of shards are at most one apart, and in every shard each stratum's count is its share of the rows, up to
    one row for each stratum. slot is the place in the shard, from 0 and gapless, in the interleaved order.
    Null texts count as empty, null strata are one stratum, null and repeated ids are dealt like any other (equal rows
    change places with no effect). Very long texts are read whole where they are scanned and never moved. An
    empty table gives no rows; with fewer rows than shards, some shards are empty. Other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.md5(text.cast("binary")).alias("md5"),
        _mixed(text, seed).alias("by_text"), _mixed(F.col(id_col), seed).alias("by_id"),
    )
    rows = _placed(rows, ["stratum", "by_text", "by_id", "id"], "strata").drop("by_text", "by_id")
    sizes = rows.groupBy("stratum").agg(F.min("place").alias("first"), F.count("*").alias("of"))
    named = sizes.select(F.col("stratum").alias("name"), "first", "of")
    share = ((F.col("place") - F.col("first")).cast("double") + 0.5) / F.col("of")
    ranked = rows.join(named, F.col("stratum").eqNullSafe(F.col("name"))).select("id", "size", "crc", "md5", share.alias("share"), F.col("place").alias("tie"))
    ranked = _placed(ranked, ["share", "tie"], "interleaved")
    n = rows.agg(F.count("*").alias("n"))
    cut = ranked.join(F.broadcast(n), F.lit(True))  # n is one row
    shard = F.expr(f"(place * {shards}) div n")
    return cut.withColumn("shard", shard.cast("int")).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("md5").alias("text_md5"), "shard",
        (F.col("place") - F.expr(f"(shard * n + {shards - 1}) div {shards}")).alias("slot"),
    )


def write_shards(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` under ``path`` as Parquet, a folder ``shard=`` for each shard, each file in the order of slots.

    Rows meet their places in ``plan`` by id and text. Rows with the same id and text are numbered first, in one task
    for each such group. Columns named shard or slot in ``docs`` are refused. An empty table writes no shard.
    """
    if taken := {"shard", "slot"} & set(docs.columns):
        raise ValueError(f"columns {sorted(taken)} are taken by the shards")
    key, number = [f"__{x}_{len(docs.columns)}" for x in ("id", "md5")], f"__copy_{len(docs.columns)}"
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    marked = docs.withColumns({key[0]: F.coalesce(F.col(id_col).cast("string"), F.lit("\0")), key[1]: digest})
    places = plan.select(F.coalesce(F.col(id_col).cast("string"), F.lit("\0")).alias(key[0]), F.col("text_md5").alias(key[1]), "shard", "slot")
    numbered = marked.withColumn(number, F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    places = places.withColumn(number, F.row_number().over(Window.partitionBy(*key).orderBy("shard", "slot")))
    out = numbered.join(places, [*key, number]).select(*docs.columns, "shard", "slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    plan = plan_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
