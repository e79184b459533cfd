"""Spans, sections, flags and routing of documents made of pages."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .latest import top_of
from .patterns import has_pattern
from .statuses import first_of_rules

SPANS = "span int, start_page bigint, end_page bigint, doc_type string, leaves array<string>, titles array<string>"


def page_type(tariff: Column, procedural: Column) -> Column:
    """tariff, procedural or unknown, by the densities of their words."""
    return first_of_rules([((tariff > 0.02) & (tariff >= procedural), "tariff"), (procedural > 0, "procedural")], "unknown")


def segment_pages(pages: DataFrame, key: str) -> DataFrame:
    """Spans of neighbouring pages about one subject: ``key``, span (from 0), pages, type, leaves and titles.

    ``pages`` has ``key``, page, doc_type, leaves and titles (arrays, not null). A page begins a span if it has leaves and
    titles, or leaves of which the current span has none, or is of type tariff after a procedural span, or has titles of which
    a tariff span has none. What a span holds grows with its pages, so a document's pages are read in order, by one
    task each; a document is as large as a file. A procedural span that meets a tariff page without a border becomes one.
    """
    kind = dict(pages.dtypes)[key]

    def walk(batch: pd.DataFrame) -> pd.DataFrame:
        spans: list[dict] = []
        for p in batch.sort_values("page").itertuples():
            leaves, titles, now = set(p.leaves), set(p.titles), spans[-1] if spans else None
            border = now is None or bool(leaves and titles)
            if not border and leaves:
                border = not leaves & now["leaves"]
            elif not border and p.doc_type == "tariff" and now["doc_type"] == "procedural" and not titles:
                border = True
            elif not border and titles and now["doc_type"] == "tariff":
                border = not titles & now["titles"]
            if border:
                spans.append({"span": len(spans), "start_page": p.page, "end_page": p.page, "doc_type": p.doc_type, "leaves": leaves, "titles": titles})
                continue
            now["end_page"] = p.page
            now["leaves"] |= leaves
            now["titles"] |= titles
            if p.doc_type == "tariff" and now["doc_type"] == "procedural":
                now["doc_type"] = "tariff"
        return pd.DataFrame([s | {key: batch[key].iloc[0], "leaves": sorted(s["leaves"]), "titles": sorted(s["titles"])} for s in spans], columns=[key, "span", "start_page", "end_page", "doc_type", "leaves", "titles"])

    return pages.groupBy(key).applyInPandas(walk, f"`{key}` {kind}, {SPANS}")


def merge_neighbours(spans: DataFrame, key: str, kind: str) -> DataFrame:
    """Neighbouring spans (start_page, end_page) of one ``kind`` that touch become one section, with its number of spans."""
    order = Window.partitionBy(key).orderBy("start_page")
    same = (F.lag(kind).over(order) == F.col(kind)) & (F.lag("end_page").over(order) >= F.col("start_page") - 1)
    numbered = spans.withColumn("section", F.sum(F.when(same, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "section", kind).agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"), F.count("*").alias("spans"))


def marker_points(text: Column, markers: Sequence[tuple[str, int]]) -> Column:
    """Sum of the weights of the patterns that a text has, in any case."""
    total = F.lit(0)
    for pattern, weight in markers:
        total = total + F.when(has_pattern(text, pattern), weight).otherwise(0)
    return total


#: What speaks for a final and for a proposed action, and for a redline, with weights.
FINAL = (
    (r"final\s+(?:order|decision|determination)", 4), (r"order\s+(?:granting|approving|denying)", 3), (r"approved\s+(?:by|the)\s+(?:the\s+)?commission", 3), (r"it\s+is\s+(?:hereby\s+)?ordered", 4), (r"so\s+ordered", 5),
    (r"(?:this|the\s+)(?:order|commission\s+order)\s+(?:is|becomes?)\s+(?:final|effective)", 3),
)
PROPOSED = ((r"proposed\s+(?:order|rates?|tariff|revision)", 3), (r"(?:notice\s+of\s+)?proposed\s+(?:rule|rulemaking)", 3), (r"draft\s+(?:order|decision)", 4), (r"pending\s+(?:approval|decision|order)", 2), (r"subject\s+to\s+(?:final\s+)?(?:commission\s+)?approval", 2))
REDLINE = ((r"(?:marked|redline|red\s*line)", 2), (r"(?:strike|stricken|strikethrough|deleted)", 3), (r"(?:inserted|added|new\s+text|underline)", 2), (r"(?:increase|decrease)\s+(?:from|to)\s+[$¢]", 1))


def final_flag(final: Column, proposed: Column) -> Column:
    """true, false or unknown: which points are more; equal points above zero speak for proposed."""
    return first_of_rules([(final > proposed, "true"), (proposed > 0, "false")], "unknown")


def redline_flag(points: Column) -> Column:
    return first_of_rules([(points >= 4, "true"), (points >= 1, "false")], "unknown")


def routing_tier(confidence: Column, consensus: Column, margin: Column) -> Column:
    """3 without consensus or below 0.5, 1 from 0.85 with a margin of 0.15, else 2."""
    sure = F.coalesce(confidence, F.lit(0.0))
    unknown = consensus.isNull() | (consensus == "")
    return F.when(unknown | (sure < 0.5), 3).when((sure >= 0.85) & (margin >= 0.15), 1).otherwise(2)


def binding(consensus: Column, safe: Column, current: Column) -> tuple[Column, Column]:
    """(status, agreement) of binding a document to its consensus profile; agreement is null without a current one."""
    none = consensus.isNull() | (consensus == "")
    status = first_of_rules([(none, "no_consensus"), (~F.coalesce(safe, F.lit(False)), "refused_unsafe")], "proposed")
    return status, F.when(~none & current.isNotNull() & (current != ""), current == consensus)


def supersede(records: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Every record with superseded_by: the ``name`` of the next record of its subject, null for the latest."""
    following = Window.partitionBy(*keys).orderBy(*order)
    return records.withColumn("superseded_by", F.lead(name).over(following))


def family_links(documents: DataFrame, families: DataFrame, document: str, family: str, least: int = 80, top: int | None = None) -> DataFrame:
    """Families that a document may belong to, best first: 100 points for a common leaf, 80 for the family's code among the
    document's, 4 for each common title word from two on, 20 at most; ``least`` points are needed.

    ``documents`` and ``families`` have ``document`` or ``family`` and arrays leaves, codes and words. Sides meet by
    equal leaf or code, one of which every match of 80 points has; words alone give too few. With ``top``, only the best so many of each
    document: families with the same leaves, codes and words have the same points, so the first ``top`` of them by name are
    enough, and documents that do not differ in them are scored once.
    """
    features = ["leaves", "codes", "words"]

    def rows(side: DataFrame, name: str) -> DataFrame:
        both = F.flatten(F.array(F.transform("leaves", lambda x: F.struct(F.lit("leaf").alias("kind"), x.alias("value"))), F.transform("codes", lambda x: F.struct(F.lit("code").alias("kind"), x.alias("value")))))
        return side.select(name, F.explode(F.array_distinct(both)).alias("x")).select(name, "x.*")

    asked = documents
    if top is not None:
        families = top_of(families.select(family, *features), features, [family], top)
        asked = documents.groupBy(*features).agg(F.min(document).alias(document))
    met = rows(asked, document).join(rows(families, family), ["kind", "value"]).groupBy(document, family).agg(
        F.max(F.when(F.col("kind") == "leaf", 100).otherwise(0)).alias("leaf"), F.max(F.when(F.col("kind") == "code", 80).otherwise(0)).alias("code")
    )
    words = met.join(asked.select(document, F.col("words").alias("w")), document).join(families.select(family, F.col("words").alias("v")), family)
    shared = F.size(F.array_intersect("w", "v"))
    score = F.col("leaf") + F.col("code") + F.when(shared >= 2, F.least(F.lit(20), shared * 4)).otherwise(0)
    ranked = words.select(document, family, score.alias("score")).where(F.col("score") >= least)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(document).orderBy(F.desc("score"), family)))
    if top is None:
        return ranked
    best = ranked.where(F.col("rank") <= top).join(asked, document).drop(document)
    return documents.select(document, *features).join(best, features).select(document, family, "score", "rank")
