"""Broken chains from families over versions to documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lineage_gaps(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """kind, document, version, family, start and path of each gap; what a kind does not have is null.

    ``documents`` has document, family, start and path, ``versions`` version, family, start, document and settled (its document is kept
    elsewhere). no_version_link: a dated document with a path that no version names. no_effective_start: an undated one
    whose path has documents of one known date only (given as start), while its family has no version of that date, or
    exactly one without a document. version_no_doc: a version without a document that is not settled. Blank dates and paths are none;
    sides meet by equality, so null families have no versions.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c)
    docs = documents.select("document", "family", blank("start"), blank("path")).where("path IS NOT NULL")
    held = versions.select("version", "family", blank("start"), "document", F.coalesce("settled", F.lit(False)).alias("settled"))
    linked = held.where("document IS NOT NULL").select("document").distinct()
    unlinked = docs.where("start IS NOT NULL").join(linked, "document", "left_anti").select(F.lit("no_version_link").alias("kind"), "document", "family", "start", "path")
    known = docs.groupBy("path").agg(F.countDistinct("start").alias("n"), F.max("start").alias("one")).where("n = 1").drop("n")
    dates = held.groupBy("family", F.col("start").alias("one")).agg(F.count("document").alias("with"), F.count_if(F.col("document").isNull()).alias("without"))
    undated = docs.where("start IS NULL").drop("start").join(known, "path").join(dates, ["family", "one"], "left")
    open_ = (F.coalesce("with", F.lit(0)) == 0) & (F.col("without").isNull() | (F.col("without") == 1))
    undated = undated.where(open_).select(F.lit("no_effective_start").alias("kind"), "document", "family", F.col("one").alias("start"), "path")
    bare = held.where("document IS NULL AND NOT settled").select(F.lit("version_no_doc").alias("kind"), "version", "family", "start")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [unlinked, undated, bare])
    return out.select("kind", "document", "version", "family", "start", "path")
