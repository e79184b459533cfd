"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last few bytes decides where chunks end, so the cuts move with the text when
something is inserted before it. Chunks are deduplicated by digest; neighbouring repeated chunks make a repeated
passage, and passages of a minimum size are reported, or cut from all documents but the first that holds them.
Digests have 128 bits, so that none are equal by chance at any size of corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .rolling import PIECE, Digests, as_bytes

#: Bytes the gear hash looks at; mean, smallest and largest chunk; bytes of repeated chunks that make a passage.
GEAR_WINDOW, MEAN, LEAST, MOST, MIN_PASSAGE = 8, 32, 8, 256, 96
_GEAR = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text, its own end included."""
    found, n = [], len(data)
    for at in range(0, n, PIECE):
        lead = min(at, GEAR_WINDOW + LEAST)
        h = _GEAR[data[at - lead : at + PIECE]]
        width = 1
        while width < GEAR_WINDOW:
            h[width:] += h[:-width] << np.uint64(width)
            width *= 2
        ends = np.flatnonzero((h >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1
        ends = ends[ends >= GEAR_WINDOW]
        # A cut with another one shortly before it does not count: a local rule, so that it moves with the text too.
        ends = ends[np.diff(ends, prepend=-LEAST - 1) >= LEAST]
        found.append(ends[ends > lead] + (at - lead))
    ends = np.concatenate((*found, [n])) if n else np.zeros(0, np.int64)
    ends = ends[: -1] if len(ends) > 1 and ends[-2] == n else ends
    sizes = np.diff(ends, prepend=0)
    if sizes.size and sizes.max() > MOST:
        starts = ends - sizes
        ends = np.concatenate([np.append(np.arange(a + MOST, b, MOST), b) for a, b in zip(starts, ends, strict=True)])
    return ends.astype(np.int64)


def chunks_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and digests (two columns of 64 bits) of a text's chunks, over its UTF-8 bytes."""
    data = np.frombuffer(as_bytes(text), np.uint8)
    ends = cuts(data)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    digests, i = [], 0
    while i < len(ends):
        base = starts[i]
        k = int(np.searchsorted(ends, base + PIECE, "right"))
        some = data[base : ends[k - 1]]
        digests.append(np.stack([Digests(some, seed).of(starts[i:k] - base, ends[i:k] - base) for seed in (1, 2)], 1))
        i = k
    return starts, ends, np.concatenate(digests).view(np.int64) if digests else np.zeros((0, 2), np.int64)


CHUNKS = "row bigint, id bigint, start int, size int, digest bigint, more bigint"


def chunk_rows(docs: DataFrame) -> DataFrame:
    """One row per chunk of ``docs`` (row, id, text)."""
    schema = common.pa_schema(docs.sparkSession, CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc = batch.column(0).to_numpy(), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                some = [chunks_of(t.as_py()) for t in batch.column(2).slice(at, 256)]
                which = np.repeat(np.arange(at, at + len(some)), [len(s[0]) for s in some])
                start, end, digest = (np.concatenate(x) for x in zip(*some, strict=True))
                arrays = [row[which], doc.take(pa.array(which)), start.astype(np.int32), (end - start).astype(np.int32), digest[:, 0], digest[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(a, f.type) if isinstance(a, np.ndarray) else a for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return docs.select("row", "id", "text").mapInArrow(run, CHUNKS)


def _repeats(docs: DataFrame, min_passage: int) -> DataFrame:
    """row, id, start, end, removed_bytes, first_id and later (chunks that are not the first of their kind) of each
    passage of repeated chunks, for docs (row, id, text)."""
    chunks = common.materialize(chunk_rows(docs), "chunks")
    place = F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("order"), "row", "start")
    known = chunks.groupBy("digest", "more").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    known = common.materialize(known, "repeated")  # then the join can split a hot digest
    again = chunks.join(known, ["digest", "more"]).select(
        "row", "id", "start", "size", F.col("first.order").alias("first_id"),
        ((F.col("first.row") != F.col("row")) | (F.col("first.start") != F.col("start"))).alias("later"),
    )
    order = Window.partitionBy("row").orderBy("start")
    begins = F.coalesce(F.col("start") != F.lag(F.col("start") + F.col("size")).over(order), F.lit(True))
    runs = again.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    passages = runs.groupBy("row", "run").agg(
        F.first("id").alias("id"), F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"),
        F.sum(F.when(F.col("later"), F.col("size")).otherwise(0)).alias("removed_bytes"), F.min("first_id").alias("first_id"),
        F.sort_array(F.collect_list(F.when(F.col("later"), F.struct("start", (F.col("start") + F.col("size")).alias("end"))))).alias("later"),
    )
    return passages.where(F.col("end") - F.col("start") >= min_passage).drop("run")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a number that stays: repeated rows and ids are told apart by it."""
    some = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return some


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_passage: int = MIN_PASSAGE) -> DataFrame:
    """Documents that hold passages which stand elsewhere too (in any document, their own included).

    One row per such document (per such input row, if ids repeat): the id, n_passages, repeated_bytes,
    removed_bytes (chunks that are not the first of their kind, in order of id), and passages as (start, end,
    first_id) in UTF-8 bytes, where first_id is the smallest id that holds one of the chunks. Passages are found
    but for up to a chunk or two at either end. Null and empty texts have no chunks; a null id comes last in
    the order and stays null. Very long texts are chunked whole, in pieces. An empty table gives no rows.
    """
    found = _repeats(_numbered(docs, id_col, text_col), min_passage)
    first = F.when(F.col("first_id") != 2**63 - 1, F.col("first_id")).alias("first_id")
    out = found.groupBy("row").agg(
        F.first("id").alias(id_col), F.count("*").alias("n_passages"), F.sum(F.col("end") - F.col("start")).alias("repeated_bytes"),
        F.sum("removed_bytes").alias("removed_bytes"), F.sort_array(F.collect_list(F.struct("start", "end", first))).alias("passages"),
    )
    return out.drop("row")


def remove_later_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_passage: int = MIN_PASSAGE) -> DataFrame:
    """``docs`` with repeated passages cut from all texts but the first that holds them, in order of id; null ids come
    last. All columns stay, rows too, and null texts stay null. What is cut are whole chunks, down to whole characters."""
    row, spans_col = (common.free(n, docs.columns) for n in ("row", "cut"))
    rows = common.materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = _repeats(rows.select(F.col(row).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), min_passage)
    cut = found.where(F.size("later") > 0).groupBy(F.col("row").alias(row)).agg(F.flatten(F.collect_list("later")).alias(spans_col))
    schema = rows.join(cut, row, "left").drop(row)

    def work(batch: dict[str, list]) -> dict[str, list]:
        for i, spans in enumerate(batch.pop(spans_col)):
            if spans:
                data, kept, at = as_bytes(batch[text_col][i]), [], 0
                for s in sorted(spans, key=lambda s: s["start"]):
                    kept.append(data[at : s["start"]])
                    at = s["end"]
                # A chunk may end inside a character; a part of one that is left over goes as well.
                batch[text_col][i] = b"".join([*kept, data[at:]]).decode("utf-8", "ignore")
        return batch

    return common.map_arrow(schema, work, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
