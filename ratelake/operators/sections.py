"""Sections of documents from signals of their pages: one fold over the ordered pages, inside the JVM.

A document's pages become an array of small structs (flags and code lists, no text), and ``aggregate`` walks it with the
section so far as its state: seeds come from runs of one kind, are split at hard boundaries, neighbours about the same
subject are merged, and each section gets a type and a confidence. No Python worker takes part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import first_of
from .statuses import first_of_rules

#: Pages of a span from which new codes alone split it, and what each agreement adds to the confidence.
LARGE_SPAN = 8
HAS_LEAVES, HAS_CODES, CLEAR_TYPE, AGREES, HAS_VALUES = 0.30, 0.20, 0.15, 0.20, 0.15
RATE_TYPES = ("rate_schedule", "rider")

FLAGS = ("header", "heading", "effective", "redline", "toc", "values")
DENSITIES = ("tariff", "procedural")
_STRINGS = "array<string>"
_SECTION = (
    f"struct<span: int, start_page: bigint, end_page: bigint, kind: string, leaves: {_STRINGS}, codes: {_STRINGS}, pages: int,"
    " headers: int, headings: int, tocs: int, values: int, tariff: double, procedural: double>"
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _none() -> Column:
    return F.array().cast(_STRINGS)


def _filled(a: Column) -> Column:
    return F.size(a) > 0


def _apart(a: Column, b: Column) -> Column:
    """Both have entries, and none in common."""
    return _filled(a) & _filled(b) & ~F.arrays_overlap(a, b)


def _tracked(p: Column, state: Column) -> Column:
    """What a page does to the leaves and codes that are being followed, as struct(leaves, codes, split), by ordered steps.

    New leaves, or new codes, split if the next page has them too. A heading with other codes splits from the third page of
    a span on without that; so do, in large spans, codes that were not there before and persist.
    """
    none, late = _none(), p["at"] >= 2

    def step(now: Column, when: Column, leaves: Column, codes: Column, splits: bool = True) -> Column:
        return F.struct(
            F.when(when, leaves).otherwise(now["leaves"]).alias("leaves"), F.when(when, codes).otherwise(now["codes"]).alias("codes"),
            (now["split"] | (when if splits else F.lit(False))).alias("split"),
        )

    lasting = F.arrays_overlap(p["codes"], p["next_codes"])
    rules = [
        lambda s: step(s, _apart(p["leaves"], s["leaves"]) & F.arrays_overlap(p["leaves"], p["next_leaves"]), p["leaves"], none),
        lambda s: step(s, _apart(p["codes"], s["codes"]) & lasting, none, p["codes"]),
        lambda s: step(s, _apart(p["codes"], s["codes"]) & p["heading"] & late, none, p["codes"]),
        lambda s: step(s, ~_filled(s["codes"]) & _filled(p["codes"]), s["leaves"], p["codes"], splits=False),
        lambda s: step(s, (p["of"] > LARGE_SPAN) & late & _filled(F.array_except(p["codes"], s["codes"])) & lasting, none, p["codes"]),
        lambda s: step(s, ~_filled(s["leaves"]) & _filled(p["leaves"]), p["leaves"], s["codes"], splits=False),
    ]
    out = state
    for rule in rules:
        out = _let(out, rule)
    return out


def _section_of(p: Column) -> Column:
    one = lambda flag: p[flag].cast("int")
    return F.struct(
        p["span"].alias("span"), p["page"].alias("start_page"), p["page"].alias("end_page"), p["kind"].alias("kind"), p["leaves"].alias("leaves"), p["codes"].alias("codes"),
        F.lit(1).alias("pages"), one("header").alias("headers"), one("heading").alias("headings"), one("toc").alias("tocs"), one("values").alias("values"),
        p["tariff"].alias("tariff"), p["procedural"].alias("procedural"),
    ).cast(_SECTION)


def _together(a: Column, b: Column, leaves: Column, codes: Column) -> Column:
    """Section ``b`` added to section ``a`` before it."""
    total = lambda c: (a[c] + b[c]).alias(c)
    return F.struct(
        a["span"].alias("span"), a["start_page"].alias("start_page"), F.greatest(a["end_page"], b["end_page"]).alias("end_page"), a["kind"].alias("kind"),
        leaves.alias("leaves"), codes.alias("codes"), total("pages"), total("headers"), total("headings"), total("tocs"), total("values"), total("tariff"), total("procedural"),
    ).cast(_SECTION)


def _refined(pages: Column) -> Column:
    """Sections of an array of pages, before neighbours are merged."""
    follow = f"struct<leaves: {_STRINGS}, codes: {_STRINGS}, split: boolean>"
    fresh = F.struct(_none().alias("leaves"), _none().alias("codes"), F.lit(False).alias("split"))
    start = F.struct(
        F.array().cast(f"array<{_SECTION}>").alias("done"), F.lit(None).cast(_SECTION).alias("open"), fresh.cast(follow).alias("follow"),
        F.lit(False).alias("effective"), F.lit(False).alias("header"), F.lit(False).alias("redline"),
    )

    def walk(acc: Column, p: Column) -> Column:
        first = p["at"] == 0
        before = F.struct(
            F.when(first, _none()).otherwise(acc["follow"]["leaves"]).alias("leaves"), F.when(first, _none()).otherwise(acc["follow"]["codes"]).alias("codes"), F.lit(False).alias("split")
        )
        dated = p["effective"] & ~acc["effective"] & ~acc["header"]
        marked = p["redline"] & ~acc["redline"]

        def placed(now: Column) -> Column:
            splits = first | now["split"] | ((p["at"] >= 2) & (dated | marked))
            own = _section_of(p)
            grown = _together(acc["open"], own, F.array_union(acc["open"]["leaves"], p["leaves"]), F.array_union(acc["open"]["codes"], p["codes"]))
            return F.struct(
                F.when(splits & acc["open"].isNotNull(), F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
                F.when(splits | acc["open"].isNull(), own).otherwise(grown).alias("open"), now.cast(follow).alias("follow"),
                p["effective"].alias("effective"), p["header"].alias("header"), p["redline"].alias("redline"),
            )

        return _let(_tracked(p, before), placed)

    return F.aggregate(pages, start, walk, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def _merged(sections: Column) -> Column:
    """Touching sections put together: within a span if leaves or codes are shared, across spans of one kind if codes are."""
    start = F.struct(F.array().cast(f"array<{_SECTION}>").alias("done"), F.lit(None).cast(_SECTION).alias("open"))

    def walk(acc: Column, s: Column) -> Column:
        a = acc["open"]
        leaves, codes = F.arrays_overlap(a["leaves"], s["leaves"]), F.arrays_overlap(a["codes"], s["codes"])
        same = a["span"] == s["span"]
        joins = a.isNotNull() & (a["end_page"] + 1 >= s["start_page"]) & ((same & (leaves | codes)) | (~same & (a["kind"] == s["kind"]) & codes))
        grown = _together(a, s, F.when(leaves, F.array_union(a["leaves"], s["leaves"])).otherwise(a["leaves"]), F.when(codes, F.array_union(a["codes"], s["codes"])).otherwise(a["codes"]))
        return F.struct(
            F.when(a.isNotNull() & ~joins, F.array_append(acc["done"], a)).otherwise(acc["done"]).alias("done"), F.when(F.coalesce(joins, F.lit(False)), grown).otherwise(s).alias("open")
        )

    return F.aggregate(sections, start, walk, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def section_type(s: Column) -> Column:
    """Type of a section by what its pages show, first rule first."""
    leaf, heading, values = s["headers"] > 0, s["headings"] > 0, s["values"] > 0
    return first_of_rules(
        [
            (s["tocs"] > s["pages"] * 0.3, "table_of_contents"), (s["procedural"] / s["pages"] > 0.05, "procedural"),
            ((s["start_page"] <= 2) & ~values & ~leaf & (s["tariff"] / s["pages"] < 0.01), "cover_letter"), (heading & values, "rate_schedule"),
            (leaf & heading & ~values, "terms_conditions"), (leaf & values, "rider"), (~leaf & ~heading & ~values, "cover_letter"), (values & ~leaf & ~heading, "terms_conditions"),
        ],
        "unknown",
    )


def build_sections(pages: DataFrame, key: str) -> DataFrame:
    """Sections of each document: ``key``, section (from 0), start_page, end_page, pages, kind, section_type, leaves and codes
    (sorted) and confidence.

    ``pages`` has ``key``, page (a whole number), kind, arrays leaves and codes, the FLAGS and the DENSITIES. Of
    several rows of one page the first counts (by kind, then codes); nulls are no, zero, no entries or the kind unknown;
    rows without a page number are left out. A span is a run of pages without a gap and of one kind. Covers and
    contents keep no leaves or codes. The pages of one document are folded in one task without their texts.
    """
    one = first_of(pages.where(F.col("page").isNotNull()), [key, "page"], ["kind", "codes"])
    sets = [F.coalesce(F.array_distinct(F.array_compact(c)), _none()).alias(c) for c in ("leaves", "codes")]
    page = F.struct(
        F.col("page").cast("bigint").alias("page"), F.coalesce("kind", F.lit("unknown")).alias("kind"), *sets,
        *(F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS), *(F.coalesce(F.col(d).cast("double"), F.lit(0.0)).alias(d) for d in DENSITIES),
    )
    held = one.groupBy(key).agg(F.sort_array(F.collect_list(page)).alias("pages"))
    touches = lambda p, i: (F.get("pages", i - 1)["kind"] == p["kind"]) & (F.get("pages", i - 1)["page"] + 1 == p["page"])
    # Where spans begin; each span's pages are described with its place and length.
    starts = F.array_compact(F.transform("pages", lambda p, i: F.when(~F.coalesce(touches(p, i), F.lit(False)), i)))
    placed = held.withColumn("starts", starts)

    def described(i: Column, start: Column, of: Column) -> Column:
        p, after = F.get("pages", i), F.when(i - start + 1 < of, F.get("pages", i + 1))
        return F.struct(
            p["page"].alias("page"), p["kind"].alias("kind"), p["leaves"].alias("leaves"), p["codes"].alias("codes"), *(p[c].alias(c) for c in (*FLAGS, *DENSITIES)),
            start.alias("span"), (i - start).alias("at"), of.alias("of"),
            F.coalesce(after["leaves"], _none()).alias("next_leaves"), F.coalesce(after["codes"], _none()).alias("next_codes"),
        )

    def span_of(start: Column, j: Column) -> Column:
        of = F.coalesce(F.get("starts", j + 1), F.size("pages")) - start
        return _let(of, lambda n: F.transform(F.sequence(start, start + n - 1), lambda i: described(i, start, n)))

    folded = placed.select(key, F.flatten(F.transform("starts", span_of)).alias("pages")).select(key, _merged(_refined(F.col("pages"))).alias("sections"))
    rows = folded.select(key, F.posexplode("sections").alias("section", "s")).withColumn("section_type", section_type(F.col("s")))
    bare = F.col("section_type").isin("cover_letter", "table_of_contents")
    kept = lambda c: F.when(bare, _none()).otherwise(F.array_sort(F.col(f"s.{c}"))).alias(c)
    rows = rows.select(key, "section", "s", "section_type", kept("leaves"), kept("codes"))
    points = lambda holds, n: F.when(holds, n).otherwise(0.0)
    agrees = F.col("section_type").isin(*RATE_TYPES) == (F.col("s.kind") == "tariff")
    confidence = points(_filled(F.col("leaves")), HAS_LEAVES) + points(_filled(F.col("codes")), HAS_CODES) + points(F.col("section_type") != "unknown", CLEAR_TYPE) + points(agrees, AGREES) + points(F.col("s.values") >= 2, HAS_VALUES)
    return rows.select(
        key, "section", "s.start_page", "s.end_page", "s.pages", "s.kind", "section_type", "leaves", "codes", F.least(F.lit(1.0), F.round(confidence, 3)).alias("confidence")
    )
