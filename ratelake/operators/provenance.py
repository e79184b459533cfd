"""Where a version came from: the discovery record of its document, what is not known, and what could fill it; and which
series of components was known when a version began."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelake.functions.rates import present

from .asof import asof_join

#: The fields of provenance, in the order in which gaps are named.
FIELDS = ["docket_number", "order_date", "leaf_no", "source_pdf", "docket_dir"]


def docket_folder(path: Column) -> Column:
    """The docket's folder in a path, in lower case; null where there is none."""
    found = F.lower(F.regexp_extract(path, r"(?i)(e-\d+-sub-\d+)", 1))
    return F.when(present(path) & (found != ""), found)


def discovery_match(documents: DataFrame, records: DataFrame) -> DataFrame:
    """``documents`` (document, path, hash and others) with linkage, record, record_docket and record_filed.

    The record with the largest number of those with the same path, and of those with the same hash, counts; where
    both are there the one by hash is taken. ``records`` has record, path, hash, docket and filed. Blank values match nothing:
    such documents get keys of their own, so that they do not meet in one task. Equality joins on one row a path or hash.
    """
    mine = documents
    for key in ("path", "hash"):
        own = F.concat(F.lit("\0"), F.xxhash64("document").cast("string"))
        mine = mine.withColumn(f"_{key}", F.when(present(F.col(key)), F.col(key)).otherwise(own))
        newest = F.max_by(F.struct("record", "docket", "filed"), "record").alias(f"_by_{key}")
        known = records.where(present(F.col(key))).groupBy(F.col(key).alias(f"_{key}")).agg(newest)
        mine = mine.join(known, f"_{key}", "left")
    by_path, by_hash = F.col("_by_path").isNotNull(), F.col("_by_hash").isNotNull()
    linkage = F.when(by_path & by_hash, "path+hash").when(by_hash, "hash_only").when(by_path, "path_only").otherwise("missing")
    taken = F.coalesce("_by_hash", "_by_path")
    return mine.select(
        *(documents[c] for c in documents.columns), linkage.alias("linkage"),
        taken["record"].alias("record"), taken["docket"].alias("record_docket"), taken["filed"].alias("record_filed"),
    )


def provenance_gaps(versions: DataFrame) -> DataFrame:
    """``versions`` of documents that miss a field, with missing and fillable (arrays in the order of FIELDS).

    Besides the fields, a row has document_leaf, path, record_docket and record_filed, from which they can be filled.
    """
    c = F.col
    source = {
        "docket_number": present(c("record_docket")), "order_date": present(c("record_filed")), "leaf_no": present(c("document_leaf")),
        "source_pdf": present(c("path")), "docket_dir": docket_folder(c("path")).isNotNull(),
    }
    missing = F.array_compact(F.array(*(F.when(~present(c(f)), f) for f in FIELDS)))
    fillable = F.array_compact(F.array(*(F.when(~present(c(f)) & source[f], f) for f in FIELDS)))
    return versions.withColumns({"missing": missing, "fillable": fillable}).where(F.size("missing") > 0)


def series_coverage(versions: DataFrame, components: DataFrame, keys: Sequence[str], expected: Sequence[str]) -> DataFrame:
    """``versions`` (keys, start and others) with the components known when each began.

    ``components`` has the keys, effective, code and kind. The codes of one day are a series; a version meets the last
    series at or before its start: same_day, carried_forward, or no_prior_series (undated versions as well, for which all of
    ``expected`` are missing). Adds effective, coverage, n_codes, missing_codes (in the order of ``expected``) and kinds (sorted).
    """
    series = components.groupBy(*keys, "effective").agg(F.sort_array(F.collect_set("code")).alias("codes"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    met = asof_join(versions, series, keys, "start", "effective")
    coverage = F.when(F.col("effective").isNull(), "no_prior_series").when(F.col("effective") == F.col("start"), "same_day").otherwise("carried_forward")
    codes = F.coalesce("codes", F.array().cast("array<string>"))
    return met.select(
        *versions.columns, "effective", coverage.alias("coverage"), F.size(codes).alias("n_codes"),
        F.array_except(F.array(*map(F.lit, expected)), codes).alias("missing_codes"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"),
    )
