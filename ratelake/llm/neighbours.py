"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives every vector a long string of hash bits (random hyperplanes; vectors are lifted so that inner
products become angles) and sorts the strings, so that a prefix of any length is a stretch of the sorted array. The
arrays are held in blocks, one for each beginning of the strings, which Spark deals out; in a block a binary search
finds the stretch of any longer prefix.

A query descends in every tree to its longest match, which has a length of its own, and learns how many vectors share
each shorter prefix. It starts at the longest prefix that has a few candidates over all trees, then ascends in
all trees at once, a few bits a step, each step scoring only what the step adds in a tree. It stops when the angle of
its current last neighbour says that a neighbour as near would have been met with the wanted probability. Where that
angle asks for prefixes so short that the trees together hold every vector more than once, the forest has nothing
to offer and the query meets all rows once, in blocks.

Candidates are ranked by the exact inner product. Blocks too large for one task are cut by rows and by queries. Of
equal vectors only as many as a result can hold take part, which changes no result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

TREES, BITS, SEED = 16, 40, 5
#: Candidates (with repeats over trees) to start with; bits of a step; wanted chance to meet the last neighbour.
ENOUGH, STEP, TARGET = 40 * TREES, 3, 0.9
#: Prefixes of this length or less hold every vector at least once over all trees.
SHORTEST = int(math.log2(TREES))
#: Vectors in a block of a sorted array (about), and at most; queries that meet a block at once.
BLOCK, BLOCK_ROWS, BLOCK_QUERIES = 4096, 8192, 4096
#: Queries of a block whose products are held at once.
_AT_ONCE = 512


def usable(col: str) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(col) > 0) & fine & F.exists(col, lambda x: x != 0), F.lit(False))


def _hashed(rows: DataFrame, dim: int, longest: float, as_query: bool, kind: str) -> DataFrame:
    """``rows`` (id, v) with keys, one hash string for each tree."""
    planes = np.random.default_rng(SEED).standard_normal((dim + 1, TREES * BITS))
    weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)

    def work(batch: dict[str, list]) -> dict[str, list]:
        x = np.asarray(batch["v"], float).reshape(-1, dim)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        # Lifted to one length, the angle to a query falls as the inner product grows.
        lift = np.zeros_like(size) if as_query else np.sqrt(np.maximum(0, 1 - (size / longest) ** 2))
        lifted = np.hstack((x / size if as_query else x / longest, lift))
        bits = (lifted @ planes > 0).reshape(-1, TREES, BITS)
        return {"id": batch["id"], "v": batch["v"], "keys": (bits @ weights).tolist()}

    return common.map_arrow(rows.select("id", "v"), work, f"id bigint, v {kind}, keys array<bigint>")


def _top(ids: np.ndarray, x: np.ndarray, q: np.ndarray, rough: np.ndarray, most: int) -> tuple[list, list]:
    """(ids, scores) of the ``most`` largest inner products, ties to the smaller id, given them up to rounding."""
    if len(rough) > most:
        # Rounding differs between blocks: keep what is near the last place, then score row by row.
        last = np.partition(rough, len(rough) - most)[len(rough) - most]
        near = np.flatnonzero(rough >= last - 1e-9 * (1 + abs(last)))
    else:
        near = np.arange(len(rough))
    score = (x[near] * q).sum(axis=1)
    order = np.lexsort((ids[near], -score))[:most]
    return ids[near][order].tolist(), score[order].tolist()


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)


def stretch(keys: np.ndarray, of: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last place, in the sorted ``keys``, of those that begin like ``of`` for ``length`` bits (none beyond BITS)."""
    low = np.maximum(0, BITS - length)
    begin = of >> low << low
    first = np.searchsorted(keys, begin)
    return first, np.where(length > BITS, first, np.searchsorted(keys, begin + (np.int64(1) << low)))


FOUND = "qid bigint, id bigint, score double"


def _meet(rows: DataFrame, asked: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on the rows and the queries of each cell; cells are cut by rows and by queries where they are large."""
    cells = asked.groupBy("cell").agg(F.count("*").alias("m")).join(rows.groupBy("cell").agg(F.count("*").alias("n")), "cell").select(
        "cell", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("row_blocks"), F.ceil(F.col("m") / BLOCK_QUERIES).cast("int").alias("query_blocks")
    )
    cells = common.materialize(cells, "cells")
    key = ["cell", "row_blocks", "query_blocks"]

    def cut(side: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        keep = [c for c in side.columns if c != "cell"]
        return side.join(cells, "cell").select("cell", *keep, mine.alias(own), every.alias(other)).select(*key, *keep)

    left, right = cut(rows, "row_blocks", "query_blocks").groupBy(*key), cut(asked, "query_blocks", "row_blocks").groupBy(*key)
    out = common.pa_schema(rows.sparkSession, schema)
    return left.cogroup(right).applyInArrow(lambda a, b: work(a, b) if a.num_rows and b.num_rows else out.empty_table(), schema)


def _arrays(rows: DataFrame, bits: int, *keep: str) -> DataFrame:
    """Each vector once in each tree: the cell (tree and first ``bits`` bits), key, id."""
    trees = rows.select("id", *keep, F.posexplode("keys").alias("tree", "key"))
    cell = F.expr(f"shiftleft(cast(tree as bigint), {BITS}) | shiftrightunsigned(key, {BITS - bits})")
    return trees.select(cell.alias("cell"), "key", "id", *keep)


def _descend(data: DataFrame, asking: DataFrame, bits: int) -> DataFrame:
    """id and shared: how many vectors, over all trees, share the first 0, 1, ... BITS bits with each query (as far as
    its blocks tell: ``bits`` at least)."""
    schema = "id bigint, shared array<bigint>"
    out = common.pa_schema(data.sparkSession, schema)
    lengths = np.arange(BITS + 1)[:, None]

    def count(rows: pa.Table, asked: pa.Table) -> pa.Table:
        keys = np.sort(rows.column("key").to_numpy())
        first, last = stretch(keys, asked.column("key").to_numpy()[None, :], lengths)
        return pa.table({"id": asked.column("id"), "shared": pa.array((last - first).T.tolist(), out.field("shared").type)}, schema=out)

    found = _meet(_arrays(data, bits), _arrays(asking, bits), count, schema)
    return found.groupBy("id").agg(F.array(*(F.sum(F.col("shared")[i]) for i in range(BITS + 1))).alias("shared"))


def _ascend(data: DataFrame, asked: DataFrame, bits: int, dim: int, most: int) -> DataFrame:
    """(qid, id, score): for queries (id, v, keys, level, seen), the best in each tree of what shares ``level`` bits with
    the query but not ``seen`` bits."""
    out = common.pa_schema(data.sparkSession, FOUND)
    below = f"greatest(0, {bits} - level)"  # a prefix shorter than a block's has several blocks
    trees = asked.select("id", "v", "level", "seen", F.posexplode("keys").alias("tree", "key"))
    first = F.expr(f"shiftleft(shiftrightunsigned(key, {BITS - bits} + {below}), {below})")
    block = F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {below})") - 1))
    trees = trees.select("id", "v", "level", "seen", "tree", "key", block.alias("block"))
    cells = trees.select(F.expr(f"shiftleft(cast(tree as bigint), {BITS}) | block").alias("cell"), "id", "v", "level", "seen", "key")

    def rank(rows: pa.Table, asking: pa.Table) -> pa.Table:
        keys = rows.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, ids, x = keys[order], rows.column("id").to_numpy()[order], _matrix(rows, dim)[order]
        of, q, qids = asking.column("key").to_numpy(), _matrix(asking, dim), asking.column("id").to_pylist()
        a, d = stretch(keys, of, asking.column("level").to_numpy())
        b, c = stretch(keys, of, asking.column("seen").to_numpy())
        got: tuple[list, list, list] = ([], [], [])
        for i, qid in enumerate(qids):
            for lo, hi in ((a[i], b[i]), (c[i], d[i])):
                if lo < hi:
                    best, score = _top(ids[lo:hi], x[lo:hi], q[i], x[lo:hi] @ q[i], most)
                    for k, v in zip(got, ([qid] * len(best), best, score), strict=True):
                        k.extend(v)
        return pa.table(dict(zip(out.names, got, strict=True)), schema=out)

    return _meet(_arrays(data, bits, "v"), cells, rank, FOUND)


def _all_rows(data: DataFrame, asked: DataFrame, n: int, dim: int, most: int) -> DataFrame:
    """(qid, id, score): the best of each block of the ``n`` rows for each query (id, v); a query goes to every block."""
    out = common.pa_schema(data.sparkSession, FOUND)

    def rank(rows: pa.Table, asking: pa.Table) -> pa.Table:
        ids, x, q, qids = rows.column("id").to_numpy(), _matrix(rows, dim), _matrix(asking, dim), asking.column("id").to_pylist()
        got: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(qids), _AT_ONCE):
            for i, rough in enumerate(q[at : at + _AT_ONCE] @ x.T, at):
                best, score = _top(ids, x, q[i], rough, most)
                for k, v in zip(got, ([qids[i]] * len(best), best, score), strict=True):
                    k.extend(v)
        return pa.table(dict(zip(out.names, got, strict=True)), schema=out)

    blocks = -(-n // BLOCK_ROWS)
    rows = data.select(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(blocks)).alias("cell"), "id", "v")
    return _meet(rows, asked.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("cell"), "id", "v"), rank, FOUND)


def _best(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of each query among (qid, id, score), each id once."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.dropDuplicates(["qid", "id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for each query row, among all other rows.

    Vectors that are null, empty, all zero, of another length than most, or hold null or non-finite components
    take no part, and neither do null ids. Rows with a query's own id are not its candidates; an id that is
    repeated counts once, with its smallest vector. Fewer than ``k`` candidates are all returned; ties go to the
    smaller id. Floats are scored as floats in double precision, other numbers as doubles. Nothing caps the candidates:
    stretches of any size are ranked whole, in blocks.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(kind).alias("v"), is_query.alias("asks")).where(usable("v"))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.countDistinct("id").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = sizes["dim"]
    rows = rows.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    rows = common.materialize(rows, "vectors")
    most = k + 1
    same = Window.partitionBy("v").orderBy("id")
    some = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= most)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    summary = some.agg(F.max(length).alias("longest"), F.count("*").alias("n")).first()
    longest, n = summary["longest"], summary["n"]
    data = common.materialize(_hashed(some, dim, longest, False, kind), "forest")
    askers = rows.where("asks").select(F.col("id").alias("query_id"), "v")
    distinct = common.materialize(_hashed(askers.groupBy("v").agg(F.min("query_id").alias("id")), dim, longest, True, kind), "queries")

    bits = min(BITS, max(0, int(math.log2(max(n, 1) / BLOCK)))) if n > BLOCK else 0
    shared = _descend(data, distinct, bits)
    levels = F.filter(F.sequence(F.lit(bits), F.lit(BITS)), lambda d: F.get("shared", d) >= ENOUGH)
    asked = distinct.join(shared, "id", "left").withColumn("level", F.coalesce(F.array_max(levels), F.lit(bits)))
    asked = common.materialize(asked.select("id", "v", "keys", "level", F.lit(BITS + 1).alias("seen")), "asked")
    need = math.log(1 - (1 - TARGET) ** (1 / TREES))
    found, settled = None, []
    while not asked.isEmpty():  # a step fewer bits each time: BITS / STEP + 1 times at most
        new = _ascend(data, asked, bits, dim, most)
        # Queries that are done leave the loop with what they have found.
        found = common.materialize(_best(new if found is None else found.select(*new.columns).unionByName(new), most).drop("rank"), "found")
        last = found.groupBy("qid").agg(F.min("score").alias("last"), F.count("*").alias("have"))
        meet = 1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("last") / (length * longest)))) / math.pi
        # Too few found say nothing but that a step is due.
        step = F.greatest(F.lit(0), F.col("level") - STEP)
        wanted = F.when(F.col("have") < most, step).when(meet <= 0, 0).when(meet >= 1, BITS).otherwise(F.floor(F.lit(need) / F.log(meet)))
        state = asked.join(last, asked["id"] == last["qid"], "left").withColumn("wanted", F.coalesce(wanted, step).cast("int"))
        state = common.materialize(state.select("id", "v", "keys", "level", "wanted"), "state")
        settled.append(found.join(state.where("wanted >= level").select(F.col("id").alias("qid")), "qid", "left_semi"))
        short = state.where(f"wanted < level AND wanted <= {SHORTEST}")
        settled.append(_all_rows(data, short, n, dim, most))
        asked = state.where(f"wanted < level AND wanted > {SHORTEST}")
        found = found.join(asked.select(F.col("id").alias("qid")), "qid", "left_semi")
        asked = asked.select("id", "v", "keys", F.greatest("wanted", F.col("level") - STEP).alias("level"), F.col("level").alias("seen"))

    if not settled:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    every = settled[0].select("qid", "id", "score")
    for some in settled[1:]:
        every = every.unionByName(some.select("qid", "id", "score"))
    best = common.materialize(_best(every, most), "best")
    names = askers.join(distinct.select("v", F.col("id").alias("qid")), "v").select("query_id", "qid")
    result = names.join(best.select("qid", "id", "score"), "qid").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    result = result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return result.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
