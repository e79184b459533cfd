"""Exact substring deduplication by a depth-limited radix sort of suffixes.

Suffixes matter only through their first ``depth`` bytes, so they are sorted by that many and no more, most
significant digit first, and a suffix that is alone in its group drops out at once. What remains when the
depth is reached are exactly the windows that stand in several places.

The first digit is one that neighbouring suffixes share: the least hash among the short grams of their first
``depth`` bytes. Equal windows have the same least gram at the same place, so a stretch of suffixes moves
through the first passes as one row, and stretches whose bytes are equal as a whole are settled in one group.
Only stretches that share their gram but not all bytes are sorted suffix by suffix, in passes over digits
of 50 bytes. Where a group is too large for one task, Spark passes come first: stretches are cut into shorter ones
by where their suffixes hold the gram, and the bytes that all suffixes of such a piece share are the next digit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .rolling import PIECE, Digests, as_bytes, mix, sliding_min

DEPTH, GRAM, DIGIT = 400, 32, 50
_PLACE = np.uint64(0xFFFFFF)
#: Different stretches of one digit that a task sorts in memory, and how short larger groups cut theirs, pass by pass.
IN_TASK, WIDTHS = 512, (64, 8, 1)
#: Classes of equal stretches that are broadcast at most (24 bytes each).
HOT_CLASSES = 20_000
RUNS = "gram bigint, u1 bigint, u2 bigint, row bigint, first int, n int, at int"


def stretches(data: np.ndarray, depth: int = DEPTH) -> list[np.ndarray]:
    """Stretches of suffixes with one least gram: gram, two digests of all their bytes, first suffix, suffixes, place of the gram."""
    gram = min(GRAM, depth)
    out = []
    for at in range(0, len(data) - depth + 1, PIECE):
        some = data[at : at + PIECE + depth - 1]
        one, two = Digests(some, 1), Digests(some, 2)
        hashes = one.windows(gram)
        least = sliding_min((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), depth - gram + 1)
        place = (least & _PLACE).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        n = np.diff(first, append=len(place))
        end = first + n - 1 + depth
        out.append([hashes[place[first]].view(np.int64), one.of(first, end).view(np.int64), two.of(first, end).view(np.int64), first + at, n, place[first] - first])
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6


def radix_repeats(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Which of the suffixes at ``starts`` agree through ``depth`` bytes with another of their group.

    Most-significant-digit passes: sort by group and next digit, drop what is alone, go on with the rest.
    """
    digests = Digests(data, 3)
    alive = np.arange(len(starts))
    for k in range(0, depth, DIGIT):
        if not len(alive):
            break
        a = starts[alive] + k
        digit = digests.of(a, a + min(DIGIT, depth - k))
        order = np.lexsort((digit, group))
        g, d = group[order], digit[order]
        new = np.concatenate(([False], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
        number = np.cumsum(new)
        keep = np.bincount(number)[number] > 1
        alive, group = alive[order][keep], number[keep]
    return np.sort(alive)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal stretches covered by the spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of the runs of consecutive numbers in a sorted array."""
    if not len(flags):
        return []
    breaks = np.flatnonzero(np.diff(flags) != 1) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(flags, breaks)]


def _stretch_rows(rows: DataFrame, depth: int) -> DataFrame:
    schema = common.pa_schema(rows.sparkSession, RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0).to_numpy()
            for at in range(0, batch.num_rows, 128):
                some = [stretches(np.frombuffer(as_bytes(t.as_py()), np.uint8), depth) for t in batch.column(1).slice(at, 128)]
                which = np.repeat(row[at : at + 128], [len(s[0]) for s in some])
                gram, u1, u2, first, n, place = (np.concatenate(x) for x in zip(*some, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip((gram, u1, u2, which, first, n, place), schema, strict=True)], schema=schema)

    return rows.select("row", "text").mapInArrow(run, RUNS)


CONTEXT = "gram bigint, classes bigint, row bigint, first int, n int, at int, bytes binary"
SPANS = "row bigint, first int, last int"


def _contexts(rows: DataFrame, unlike: DataFrame, depth: int) -> DataFrame:
    """The bytes of the stretches ``unlike`` (gram, classes, row, first, n, at)."""

    def work(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.split()[0]: [] for f in CONTEXT.split(", ")}
        for row, text, asked in zip(batch["row"], batch["text"], batch["asked"], strict=True):
            data = as_bytes(text)
            for x in asked:
                for k in ("gram", "classes", "first", "n", "at"):
                    out[k].append(x[k])
                out["row"].append(row)
                out["bytes"].append(data[x["first"] : x["first"] + x["n"] - 1 + depth])
        return out

    by_row = unlike.groupBy("row").agg(F.collect_list(F.struct("gram", "classes", "first", "n", "at")).alias("asked"))
    return common.map_arrow(rows.join(by_row, "row").select("row", "text", "asked"), work, CONTEXT, 128)


def _sort_in_task(contexts: DataFrame, depth: int) -> DataFrame:
    """Spans of repeated suffixes among contexts of grams with few different stretches."""
    schema = common.pa_schema(contexts.sparkSession, SPANS)

    def settle(held: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(h[5] for h in held), np.uint8)
        n = np.array([h[3] for h in held])
        base = np.cumsum([0, *(len(h[5]) for h in held[:-1])])
        owner = np.repeat(np.arange(len(held)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gram = np.unique(np.array([h[0] for h in held]), return_inverse=True)[1]
        # Equal windows hold their gram at one place: gram and place are the digit sorted by already.
        group = gram[owner] * (depth + 1) + np.array([h[4] for h in held])[owner] - step
        alive = radix_repeats(data, base[owner] + step, group, depth)
        rows = [(held[o][1], held[o][2] + a, held[o][2] + b) for o in np.unique(owner[alive]) for a, b in _runs(step[alive[owner[alive] == o]])]
        return pa.RecordBatch.from_pydict(dict(zip(("row", "first", "last"), zip(*rows, strict=True) if rows else ([], [], []), strict=True)), schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for x in zip(*(batch.column(k).to_pylist() for k in ("gram", "row", "first", "n", "at", "bytes")), strict=True):
                if held and x[0] != held[-1][0] and size > PIECE // 2:
                    yield settle(held)
                    held, size = [], 0
                held.append(x)
                size += len(x[5])
        if held:
            yield settle(held)

    few = contexts.where(F.col("classes") <= IN_TASK)
    return few.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, SPANS)


PIECES = RUNS + ", bytes binary"


def _cut(contexts: DataFrame, width: int, depth: int) -> DataFrame:
    """Stretches cut where the place of their gram crosses a multiple of ``width``; their digit is what all suffixes
    with such places have in common, so that equal suffixes are in pieces with equal digits."""

    def work(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.split()[0]: [] for f in PIECES.split(", ")}
        for gram, row, first, n, at, raw in zip(*(batch[k] for k in ("gram", "row", "first", "n", "at", "bytes")), strict=True):
            data = np.frombuffer(raw, np.uint8)
            one, two = Digests(data, 1), Digests(data, 2)
            block = np.arange((at - n + 1) // width, at // width + 1)
            begin, end = np.maximum(0, at - block * width - width + 1), np.minimum(n, at - block * width + 1)
            core = one.of(at - block * width, at - block * width - width + 1 + depth)
            digit = mix(core ^ mix(block.astype(np.uint64) + np.uint64(gram & 0xFFFFFFFFFFFFFFFF)))
            out["gram"] += digit.view(np.int64).tolist()
            for k, d in (("u1", one), ("u2", two)):
                out[k] += d.of(begin, end - 1 + depth).view(np.int64).tolist()
            out["row"] += [row] * len(block)
            out["first"] += (first + begin).tolist()
            out["n"] += (end - begin).tolist()
            out["at"] += (at - begin).tolist()
            out["bytes"] += [raw[a : b - 1 + depth] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        return out

    return common.map_arrow(contexts, work, PIECES, 256)


def _settle(runs: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """One pass over stretches by their digit: spans of those equal to another as a whole, and one of each kind of
    the others that share their digit (gram, classes, row, first, n, at and ``more``)."""
    # Written first, so that the join meets two plain shuffles and a hot digit's side can be split.
    shared = common.materialize(runs.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram"), "shared")
    again = common.materialize(runs.join(shared, "gram", "left_semi"), "again")
    classes = again.groupBy("gram", "u1", "u2").agg(F.count("*").alias("members"), F.min(F.struct("row", "first", "n", "at", *more)).alias("one"))
    classes = common.materialize(classes, "classes")
    key, many = ["gram", "u1", "u2"], classes.where("members > 1")
    # Stretches of the largest classes stay where they are. By their size they are HOT_CLASSES at most.
    hot = common.materialize(many.where(F.col("members") > again.count() // HOT_CLASSES).select(*key), "hot")
    at_once = again.join(F.broadcast(hot), key, "left_semi")
    others = again.join(F.broadcast(hot), key, "left_anti").join(many.join(F.broadcast(hot), key, "left_anti").select(*key), key, "left_semi")
    equal = at_once.unionByName(others)
    # Written for the same reason: a digit with very many classes is met by several tasks.
    several = common.materialize(classes.groupBy("gram").agg(F.count("*").alias("classes")).where("classes > 1"), "several")
    spans = equal.select("row", "first", (F.col("first") + F.col("n")).alias("last"))
    return spans, classes.join(several, "gram").select("gram", "classes", "one.*")


def repeated_suffixes(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(row, first, last): suffixes first..last-1 of ``rows`` (row, text; row unique) whose first ``depth`` bytes
    stand elsewhere too. Spans may repeat and touch. Digits that stand once are dropped before anything is joined."""
    out, unlike = _settle(common.materialize(_stretch_rows(rows, depth), "stretches"))
    contexts = common.materialize(_contexts(rows, unlike, depth), "contexts")
    out = out.unionByName(_sort_in_task(contexts, depth))
    for width in (w for w in WIDTHS if w == 1 or 2 * w <= depth):
        many = contexts.where(F.col("classes") > IN_TASK)
        if many.isEmpty():
            break
        spans, unlike = _settle(common.materialize(_cut(many, width, depth), "pieces"), "bytes")
        contexts = common.materialize(unlike, "contexts")
        out = out.unionByName(spans).unionByName(_sort_in_task(contexts, depth))
    return out


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "rows")


def _with_spans(rows: DataFrame, depth: int) -> DataFrame:
    """``rows`` with the spans of their repeated suffixes (null without any)."""
    spans = repeated_suffixes(rows, depth).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return rows.join(spans, "row", "left").select("id", "text", "spans")


def remove_repeats(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every byte covered by a ``depth``-byte string that also starts anywhere else, same document included, goes.

    One row per input row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes) and
    kept_sha256. Texts are UTF-8 bytes; nulls are empty; null ids and repeated rows are documents of their own.
    Very long texts are read whole. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"

    def work(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in (id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")}
        for doc, text, spans in zip(batch["id"], batch["text"], batch["spans"], strict=True):
            data = as_bytes(text)
            gone = joined([(s["first"], s["last"] - 1 + depth) for s in spans or []])
            kept = b"".join(data[a:b] for a, b in zip([0, *(g[1] for g in gone)], [*(g[0] for g in gone), len(data)], strict=True))
            row = (doc, len(data), len(data) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest())
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out

    return common.map_arrow(_with_spans(_numbered(docs, id_col, text_col), depth), work, schema, 256)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
