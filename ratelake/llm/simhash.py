"""SimHash near-duplicates by deletion variants.

A 64-bit fingerprint is cut into two halves. If two fingerprints differ at two bits or fewer, one half differs
at one bit at most, so both have a variant in common in which that half has one wildcard bit. Variants are
joined by equality and the other bits are verified. Exact copies meet in one fingerprint first. Where very
many fingerprints share a variant, they are not paired: finer keys, whose members all link with each other by
construction, tie them to one of their number. That is exact as well, and linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common
from .components import components

WORDS, BITS, HALF = 3, 64, 32
#: Variants with more members than this are tied by finer keys instead of in pairs.
DENSE = 48
_CHUNK = 1 << 15
_LOWER_HALF = (1 << HALF) - 1


def fingerprint(text: str) -> int:
    """SimHash of the 3-word shingles: unsigned XXH64 with seed 42, a bit is 1 if set in over half of them."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < WORDS:
        words = [b" ".join(words), b"", b""]
        n = 1
    else:
        n = len(words) - WORDS + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        some = words[at : at + _CHUNK + WORDS - 1]
        if n == 1 and not words[1]:
            hashes = [xxhash.xxh64_intdigest(words[0], 42)]
        else:
            hashes = [xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(some, some[1:], some[2:], strict=False))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and fp (the fingerprint as a signed long), one row per input row."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        found = np.array([fingerprint(t or "") for t in rows[text_col]], np.uint64).view(np.int64)
        return {id_col: rows[id_col], "fp": found.tolist()}

    kind = dict(docs.dtypes)[id_col]
    return common.map_arrow(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, fp bigint")


def _half(fp: Column, high: int) -> Column:
    return F.shiftrightunsigned(fp, HALF) if high else fp.bitwiseAND(F.lit(_LOWER_HALF))


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): for each half and each of its bits, the half without that bit, with half and bit in the key."""
    bit = F.col("bit")
    pos = (bit % HALF).cast("int")
    half = F.when(bit >= HALF, _half(F.col("fp"), 1)).otherwise(_half(F.col("fp"), 0))
    masked = half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, cast(bit % 32 as int))")))
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit")).select(
        F.expr("shiftleft(cast(bit as bigint), 32)").bitwiseOR(masked).alias("key"), "fp"
    )


def _ties(members: DataFrame) -> DataFrame:
    """Links among the fingerprints of crowded variants, at most one for each member and finer key.

    With the shared half equal up to a wildcard bit, either the other half is equal up to one bit as well (both
    wildcards make a key), or the shared half is equal and the other half is equal up to two bits (the shared
    half and two wildcards make a key). Members of one such key differ at two bits at most: a star ties them.
    """
    other = "CASE WHEN shiftrightunsigned(key, 37) = 1 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END"
    own = "CASE WHEN shiftrightunsigned(key, 37) = 1 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END"
    rows = members.withColumns({"other": F.expr(other), "own": F.expr(own)})
    one = rows.select("fp", "key", "other", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i")).select(
        "fp", "key", F.expr("(other & ~shiftleft(1L, i)) | shiftleft(cast(i as bigint), 40)").alias("rest")
    )
    pairs = [(i, j) for i in range(HALF) for j in range(i + 1, HALF)]
    masks = F.array(*(F.lit((1 << i) | (1 << j)).cast("bigint") for i, j in pairs))
    same = rows.select("fp", "other", (F.shiftrightunsigned("key", 37)).alias("side"), "own").distinct()
    two = same.select("fp", "side", "own", "other", F.posexplode(masks).alias("i", "mask")).select(
        "fp", F.expr("-1 - (own | shiftleft(side, 32))").alias("key"),
        F.expr("(other & ~mask) | shiftleft(cast(i as bigint), 40)").alias("rest"),
    )
    fine = one.unionByName(two)
    least = fine.groupBy("key", "rest").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return fine.join(least.drop("n").hint("merge"), ["key", "rest"]).where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def _crowded_halves(fps: DataFrame) -> DataFrame:
    """(side, half, key): crowded keys and the two halves that have each of them as a variant.

    A key is crowded if it is a variant of a half that more than DENSE / 2 fingerprints have; any other key has
    DENSE members at most.
    """
    hot = _halves(fps).groupBy("side", "half").agg(F.count("*").alias("n")).where(F.col("n") > DENSE // 2)
    bits = hot.select("side", "half", F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))).alias("bit"))
    key = F.expr("shiftleft(cast(side * 32 + bit as bigint), 32) | (half & ~shiftleft(1L, bit))")
    both = F.expr("explode(array(half, half ^ shiftleft(1L, bit)))")
    return bits.select("side", key.alias("key"), both.alias("half")).distinct()


def _halves(fps: DataFrame, *more: str) -> DataFrame:
    """(side, half) and ``more`` for both halves of each fingerprint."""
    both = F.array(*(F.struct(F.lit(i).alias("side"), _half(F.col("fp"), i).alias("half")) for i in (0, 1)))
    return fps.select(*more, F.inline(both))


def links(fps: DataFrame, within: int = 2) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fps.fp`` within two bits of each other.

    All links of sparse variants are there. Crowded variants give stars with the same components.
    """
    if within != 2:
        raise ValueError("the variants are made for a distance of two")
    variants = _variants(fps)
    near = common.materialize(_crowded_halves(fps), "crowded")
    some = not near.isEmpty()
    # What is crowded grows with the input: it is never broadcast, and its members are found by half, not by variant.
    crowded = near.select("key").distinct().hint("merge")
    sparse = variants.join(crowded, "key", "left_anti") if some else variants
    left, right = sparse.select("key", F.col("fp").alias("a")), sparse.select("key", F.col("fp").alias("b"))
    out = left.join(right, "key").where("a < b").where(_apart("a", "b") <= within).select("a", "b")
    if some:
        members = _halves(fps, "fp").join(near.hint("merge"), ["side", "half"]).select("key", "fp")
        out = out.unionByName(_ties(common.materialize(members, "members")))
    return out


def _classes(marked: DataFrame, id_col: str) -> DataFrame:
    """fp, component (a fingerprint of the group) and component_id (smallest id of the group) for each fingerprint."""
    fps = common.materialize(marked.groupBy("fp").agg(F.min(id_col).alias("first")), "classes")
    found = components(links(fps.select("fp")))
    named = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return named.join(least, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fingerprint (16 hex digits) and component_id, one row per input row.

    Documents are linked if their fingerprints differ at two bits or fewer; component_id is the smallest id
    reachable. Null and empty texts have fingerprint zero and are linked like any other; null ids take part
    in linking and are never the smallest unless all are null (then component_id is null); repeated rows are kept. Very long texts are read whole. An empty table gives no rows.
    """
    marked = common.materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    named = marked.join(_classes(marked, id_col), "fp")
    return named.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: a row with the group's smallest id (of several such rows
    the first read), or any row of a group whose ids are all null. All columns stay as they are, whatever their names."""
    fp, row = (common.free(n, docs.columns) for n in ("fp", "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                found = np.array([fingerprint(t or "") for t in some.column(text_col).to_pylist()], np.uint64).view(np.int64)
                yield some.append_column(fp, pa.array(found, pa.int64()))

    schema = StructType([*docs.schema.fields, StructField(fp, LongType())])
    marked = docs.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id())
    marked = common.materialize(marked, "fingerprints")
    narrow = marked.select(F.col(id_col).alias("__id"), F.col(fp).alias("fp"), F.col(row).alias("__row"))
    named = narrow.join(_classes(narrow.select("__id", "fp"), "__id"), "fp")
    kept = named.where("__id <=> component_id").groupBy("component").agg(F.min("__row").alias(row)).select(row)
    return marked.join(kept, row, "left_semi").select(*docs.columns)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
