"""Nearest neighbours of a stated set of rows among all others, by blocks of both sides, and the labels they vote for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries, and other rows, that meet in one task; two blocks of 64 numbers take 30 MB.
QUERY_BLOCK, ROW_BLOCK = 2048, 16384
#: Queries of a block that are scored at once: scores of 64 queries with a block of rows take 8 MB, of a whole block 268 MB.
AT_ONCE = 64


def block_best(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """query, id and score of the ``k`` rows of a block ``b`` (id, v) nearest to each row of a block ``a`` (id, v), itself left out."""
    out: dict[str, list] = {"query": [], "id": [], "score": []}
    for size in sorted({len(v) for v in a["v"]} & {len(v) for v in b["v"]}):
        x, y = (s[[len(v) == size for v in s["v"]]] for s in (a, b))
        unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (np.stack(list(s["v"])).astype(float) for s in (x, y))]
        asked, ids = x["id"].to_numpy(), y["id"].to_numpy()
        for at in range(0, len(asked), AT_ONCE):
            scores = unit[0][at : at + AT_ONCE] @ unit[1].T
            for own, found in zip(asked[at : at + AT_ONCE], scores, strict=True):
                row = np.where(ids == own, -np.inf, found)
                # All rows as near as the k-th, so that ties are settled by id.
                keep = np.flatnonzero(row >= np.partition(row, -min(k, len(row)))[-min(k, len(row))])
                keep = keep[np.isfinite(row[keep])]
                keep = keep[np.lexsort((ids[keep], -row[keep]))][:k]
                for name, part in zip(out, (np.full(len(keep), own), ids[keep], row[keep]), strict=True):
                    out[name].append(part)
    return pd.DataFrame({name: np.concatenate(parts) if parts else [] for name, parts in out.items()})


def nearest(queries: DataFrame, rows: DataFrame, ident: str, vector: str, k: int = 11) -> DataFrame:
    """query, ``ident``, score (cosine, in double precision) and rank (from 1) of the ``k`` rows nearest to each query, ties to the
    smaller ``ident``; a query's own row takes no part.

    ``ident`` is a whole number and tells rows apart. Null vectors, zero vectors, and those with null or non-finite entries or of
    another length than a query's take no part. Both sides are cut into blocks by a hash of ``ident``; each pair of
    blocks is one matrix product in one task, gives at most k rows a query, and what the blocks give is merged by query.
    """
    vec = F.col(vector).cast("array<double>")
    fine = F.forall(vec, lambda c: F.coalesce(c.between(-1.7e308, 1.7e308), F.lit(False))) & F.exists(vec, lambda c: c != 0)
    usable = lambda side: side.where(F.col(ident).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(ident).cast("bigint").alias("id"), vec.alias("v"))
    asked, held = usable(queries), usable(rows)
    n_q, n_r = (max(1, -(-side.count() // size)) for side, size in ((asked, QUERY_BLOCK), (held, ROW_BLOCK)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = asked.withColumn("q", block(n_q)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    right = held.withColumn("r", block(n_r)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return block_best(a, b, k)

    found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInPandas(best, "query bigint, id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).withColumnRenamed("id", ident)


def vote(neighbours: DataFrame, labels: DataFrame, ident: str, label: str, confidence: str, least: int = 5) -> DataFrame:
    """query, label, share (its part of all weight) and neighbours for each query of ``nearest``: neighbours weigh by score times confidence.

    Neighbours without a label do not count; with fewer than ``least`` others the label is null and the share 0. Of equal
    labels the smaller wins; weights below zero count as zero.
    """
    known = labels.where(F.col(label).isNotNull()).select(F.col(ident).alias("__id"), F.col(label).alias("__label"), F.coalesce(F.col(confidence).cast("double"), F.lit(0.5)).alias("__sure"))
    met = neighbours.join(known, F.col(ident) == F.col("__id"))
    weights = met.groupBy("query", "__label").agg(F.round(F.sum(F.greatest(F.lit(0.0), F.col("score") * F.col("__sure"))), 9).alias("w"), F.count("*").alias("n"))
    total = weights.groupBy("query").agg(F.sum("w").alias("all"), F.sum("n").alias("neighbours"), F.min_by("__label", F.struct((-F.col("w")).alias("w"), "__label")).alias("label"), F.max("w").alias("w"))
    enough = (F.col("neighbours") >= least) & (F.col("all") > 0)
    counted = total.select("query", F.when(enough, F.col("label")).alias("label"), F.when(enough, F.col("w") / F.col("all")).otherwise(0.0).alias("share"), "neighbours")
    return neighbours.select("query").distinct().join(counted, "query", "left").select("query", "label", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))
