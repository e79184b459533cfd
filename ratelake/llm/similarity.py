"""Near copies by similarity, for the pipeline: texts whose five-word shingles overlap by 0.8 or more.

Fingerprints two bits apart (``simhash``) find hardly more than exact copies of long texts; this pass follows them. Texts
with the same set of shingles are one class. Min-hashes of a class are cut into bands, classes that share a band are
candidates, and every candidate pair is verified on its whole sets of shingles, so no pair below 0.8 is ever linked. A pair
at the border of 0.8 shares a band with a chance of 0.992 only, so an exact join follows: what bands did not connect meets by prefixes
(see ``_rest``), which leave out no pair.

A band that few classes share gives all its pairs. Where many do, they are compared with a few hubs drawn from among them; those that
are like a hub are linked to it, the rest goes through another round with other hubs until few are left. So pairs grow
with the classes, not with their square. Two classes in one crowded band that are like each other, but like different hubs, may be
missed there; the exact join finds them, too. It tries only pairs that no chain of links connects yet, so large groups of near copies, which
bands have connected, cost it nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import components

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 6
#: Classes in a band that are all compared; hubs of a band with more.
FEW, HUBS = 16, 8
#: Shingles beyond the prefix, as a part of all, that must be shared as well before a class is looked at whole.
EXTRA = 0.1
_PIECE = 1 << 13
_RNG = np.random.default_rng(11)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes, sorted, of the shingles of a text in lower case (fewer words than five: of all its words)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 5)], np.uint64)
    runs = zip(*(words[i:] for i in range(SHINGLE)), strict=False)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), 5) for r in runs), np.uint64, len(words) - SHINGLE + 1))


def band_keys(hashes: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _PIECE):
        least = np.minimum(least, (hashes[at : at + _PIECE, None] * _FACTORS + _SHIFTS).min(0))
    signed = [xxhash.xxh64_intdigest(m.tobytes(), i) for i, m in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(signed, np.uint64).view(np.int64).tolist()


def spare(n: int, similar: float) -> int:
    """How many of ``n`` shingles a text similar enough may lack."""
    return n - math.ceil(similar * n - 1e-9)


def _sketches(rows: DataFrame, similar: float) -> DataFrame:
    """row, n (distinct shingles), same (digest of their set), keys and least (the smallest shingles, see ``_rest``) for rows (row,
    text); texts without words have none."""

    def work(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"row": [], "n": [], "same": [], "keys": [], "least": []}
        for row, text in zip(batch["row"], batch["text"], strict=True):
            found = shingles(text)
            if len(found):
                least = found[: spare(len(found), similar) + 1 + int(EXTRA * len(found))].view(np.int64)
                for name, value in zip(out, (row, len(found), xxhash.xxh3_128_digest(found.tobytes()), band_keys(found), least), strict=True):
                    out[name].append(value)
        return out

    return common.map_arrow(rows.select("row", "text"), work, "row bigint, n int, same binary, keys array<bigint>, least array<bigint>", 64)


def _alike(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Those of the distinct pairs (a, b) of rows whose texts are similar enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()

    def work(batch: dict[str, list]) -> dict[str, list]:
        return {"row": batch["row"], "grams": [shingles(t).tobytes() for t in batch["text"]]}

    sets = common.map_arrow(texts.join(wanted, "row", "left_semi").select("row", "text"), work, "row bigint, grams binary", 64)
    sets = common.materialize(sets, "shingles")
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("grams").alias("y")), "b")
    out = common.pa_schema(texts.sparkSession, "a bigint, b bigint")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in (2, 3))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared >= similar * (len(x) + len(y) - shared):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in (0, 1)], schema=out)

    return common.materialize(both.select("a", "b", "x", "y").mapInArrow(judge, "a bigint, b bigint"), "alike")


def _pairs(left: DataFrame, right: DataFrame, similar: float) -> DataFrame:
    """Distinct pairs a < b of rows of both sides that share a key and are near enough in size."""
    met = left.select("key", F.col("row").alias("p"), F.col("n").alias("n_p")).join(right.select("key", F.col("row").alias("q"), F.col("n").alias("n_q")), "key")
    near = met.where("p <> q").where(F.least("n_p", "n_q") >= F.lit(similar) * F.greatest("n_p", "n_q"))
    return near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _rest(classes: DataFrame, texts: DataFrame, found: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) between classes (row, n, least) that are similar enough and that no chain of the links ``found`` connects: all there are.

    Of two texts similar enough each lacks at most ``spare`` shingles of what they share. So in whatever order, as long as it is the
    same for all, the first spare + k shingles of both hold k common ones. That is used twice: classes of whose smallest hashes
    too few stand in any other class have no partner and go; of the others, the rarest spare + 1 shingles are keys. Pairs that
    share a key are verified.
    """
    need = F.ceil(F.col("n") * F.lit(similar) - 1e-9).cast("int")
    shared = lambda grams: grams.join(grams.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key")
    least = classes.select("row", "n", F.explode("least").alias("key"))
    # A partner has at least ``need`` shingles, and its own smallest hashes reach as far as that asks for.
    enough = F.col("held") > F.floor(F.lit(EXTRA) * need)
    likely = shared(least).groupBy("row", "n").agg(F.count("*").alias("held")).where(enough).select("row", "n")
    likely = common.materialize(likely, "likely")

    def work(batch: dict[str, list]) -> dict[str, list]:
        return {"row": batch["row"], "grams": [shingles(t).view(np.int64) for t in batch["text"]]}

    grams = common.map_arrow(texts.join(likely, "row", "left_semi").select("row", "text"), work, "row bigint, grams array<bigint>", 64)
    grams = common.materialize(grams.select("row", F.explode("grams").alias("key")), "grams")
    mine = Window.partitionBy("row")
    rated = shared(grams).join(likely, "row").withColumns({"place": F.row_number().over(mine.orderBy("m", "key")), "held": F.count("*").over(mine)})
    # Shingles that no other class has come before all these.
    keys = rated.where((F.col("held") >= need) & (F.col("place") <= F.col("held") - need + 1)).select("key", "row", "n")
    groups = components(found)
    named = keys.join(groups.select(F.col("node").alias("row"), "component"), "row", "left").withColumn("group", F.coalesce("component", "row"))
    named = common.materialize(named.select("key", "row", "n", "group"), "prefixes")
    mixed = named.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x < y").select("key")
    open_ = named.join(mixed, "key")
    sides = [open_.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("row", "n", "group"))) for side in ("p", "q")]
    met = sides[0].join(sides[1], "key").where("group_p < group_q").where(F.least("n_p", "n_q") >= F.lit(similar) * F.greatest("n_p", "n_q"))
    pairs = met.select(F.least("row_p", "row_q").alias("a"), F.greatest("row_p", "row_q").alias("b")).distinct()
    return _alike(pairs, texts, similar)


def links(texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Links (a, b) between rows of ``texts`` (row, text) that are similar enough: any two such rows are linked, or connected by
    a chain of links. Classes of equal sets are tied to their first row."""
    sketches = common.materialize(_sketches(texts, similar), "sketches")
    classes = common.materialize(sketches.groupBy("same").agg(F.min(F.struct("row", "n", "keys", "least")).alias("first")), "classes")
    equal = sketches.select("same", "row").join(classes.select("same", F.col("first.row").alias("a")), "same").where("row <> a").select("a", F.col("row").alias("b"))
    members = classes.select(F.col("first.row").alias("row"), F.col("first.n").alias("n"), F.explode("first.keys").alias("key"))
    found, rounds = [equal], 0
    while True:
        # Keys are counted by partial sums; a crowded key is joined by equality and can be split.
        counts = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        sized = common.materialize(members.join(counts, "key"), "members")
        few, many = sized.where(F.col("m") <= FEW), sized.where(F.col("m") > FEW)
        found.append(_alike(_pairs(few, few, similar), texts, similar))
        if many.isEmpty():
            break
        drawn = F.pmod(F.xxhash64("key", "row", F.lit(rounds)), F.col("m")) < HUBS
        hubs, others = many.where(drawn), many.where(~drawn)
        alike = _alike(_pairs(many, hubs, similar), texts, similar)
        found.append(alike)
        near = alike.select(F.explode(F.array(F.struct(F.col("a").alias("row"), F.col("b").alias("hub")), F.struct(F.col("b").alias("row"), F.col("a").alias("hub")))).alias("l")).select("l.*")
        tied = near.join(hubs.select(F.col("row").alias("hub"), "key"), "hub").select("key", "row").distinct()
        members = common.materialize(others.join(tied, ["key", "row"], "left_anti").select("row", "n", "key"), "left")
        rounds += 1
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = common.materialize(out.distinct(), "links")
    return out.unionByName(_rest(classes.select("first.row", "first.n", "first.least"), texts, out, similar))


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each group of similar texts: that with the smallest id (null ids come last, of equal ids the
    first read). All columns stay as they are.

    Groups are what links of similar texts connect. Null texts, empty ones and others without words are like nothing and all stay;
    texts of up to five words are like those of the same words only. Very long texts are read whole. An empty table gives no rows.
    """
    row, text, mine = (common.free(n, docs.columns) for n in ("row", "text", "id"))
    marked = common.materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = components(links(marked.select(F.col(row).alias("row"), F.col(text_col).alias("text")), similar))
    places = marked.select(F.col(row).alias("node"), F.col(id_col).alias(mine))
    named = found.join(places, "node")
    first = named.groupBy("component").agg(F.min(F.struct(F.col(mine).isNull().alias("none"), F.col(mine).alias("id"), "node")).alias("first"))
    gone = named.join(first, "component").where(F.col("node") != F.col("first.node")).select(F.col("node").alias(row))
    return marked.join(common.materialize(gone, "gone"), row, "left_anti").select(*docs.columns)
