"""Nearest labelled vectors for a list of queries, votes and retrieval measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratelake.functions.text import cosine

from .latest import top_of

#: Queries that one search takes at most: each task holds them all.
MAX_QUERIES = 10_000


def search(queries: DataFrame, vectors: DataFrame, k: int, min_similarity: float | None = None) -> DataFrame:
    """query_id, id, label, similarity, rank: the ``k`` vectors most like each query, exactly.

    ``queries`` (query_id, q) is a stated list, checked to be at most MAX_QUERIES and broadcast; ``vectors``
    (id, v, label) may be any size and is filtered before the cut. Each task keeps its own best ``k``, so only
    those are shuffled. Ties go to the smaller id.
    """
    n = queries.count()
    if n > MAX_QUERIES:
        raise ValueError(f"{n} queries; split them into lists of at most {MAX_QUERIES}")
    pairs = vectors.crossJoin(F.broadcast(queries)).withColumn("similarity", cosine(F.col("v"), F.col("q"))).where("similarity IS NOT NULL")
    if min_similarity is not None:
        pairs = pairs.where(F.col("similarity") >= min_similarity)
    return top_of(pairs.select("query_id", "id", "label", "similarity"), ["query_id"], [F.desc("similarity"), "id"], k, "rank")


def votes(hits: DataFrame, least: int = 1) -> DataFrame:
    """query_id, label, weight, share, place: labels by summed similarity of the hits; unlabelled hits do not vote, and
    queries with fewer than ``least`` labelled hits have no result."""
    labelled = hits.where("label IS NOT NULL")
    sums = labelled.groupBy("query_id", "label").agg(F.sum("similarity").alias("weight"), F.count("*").alias("n"))
    every = Window.partitionBy("query_id")
    shares = sums.withColumns({"share": F.col("weight") / F.sum("weight").over(every), "__all": F.sum("n").over(every)})
    out = shares.where(F.col("__all") >= least).drop("__all")
    return out.withColumn("place", F.row_number().over(every.orderBy(F.desc("weight"), "label")))


def measures(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: queries, recall_at_5, recall_at_10, mrr_at_10 against ``expected`` (query_id, label)."""
    good = hits.join(expected.withColumnRenamed("label", "wanted"), "query_id").where("label = wanted AND rank <= 10")
    first = good.groupBy("query_id").agg(F.min("rank").alias("first"))
    each = expected.select("query_id").join(first, "query_id", "left")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return each.agg(
        F.count("*").alias("queries"), F.round(share(F.col("first") <= 5), 6).alias("recall_at_5"), F.round(share(F.col("first") <= 10), 6).alias("recall_at_10"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr_at_10"),
    )
