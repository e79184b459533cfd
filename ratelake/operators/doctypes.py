"""Document types by patterns in roles: strong anywhere, strong in the header only, weak, and negative, with shifts by layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of a hit in each role, characters of a first text that belong to the header, and confidences of a
#: winner by what speaks for it (with what is added for a layout that fits, and for a clear margin).
STRONG, WEAK, NEGATIVE, HEADER = 3.0, 1.0, -2.0, 120
FLOOR, SURE, UNSURE, FITTING, CLEAR, CLEAR_MARGIN = 0.2, 0.8, 0.5, 0.05, 0.1, 3.0
ROLES = ("strong", "strong_header", "weak", "negative")

Rules = Mapping[str, Mapping[str, Sequence[str]]]
#: type: (condition, shift) for layouts that speak for or against it.
Layout = Mapping[str, Sequence[tuple[Column, float]]]


def _hits(text: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + F.regexp_count(text, F.lit(f"(?i){p}"))
    return out


def type_scores(title: Column, first: Column, last: Column, rules: Rules, layout: Layout | None = None) -> Column:
    """For each type of ``rules``, in their order: struct(type, score, strong, fits). Every hit counts: STRONG for a strong pattern anywhere
    and for a header pattern in the title and the first HEADER characters of ``first``, WEAK and NEGATIVE anywhere.
    Layout shifts whose condition holds are added; fits says that one of them was above zero. Null texts are empty.
    """
    plain = lambda c: F.coalesce(c, F.lit(""))
    every = F.concat_ws("\n", plain(title), plain(first), plain(last))
    header = F.concat_ws("\n", plain(title), F.substring(plain(first), 1, HEADER))
    out = []
    for name, roles in rules.items():
        if extra := set(roles) - set(ROLES):
            raise ValueError(f"unknown roles {sorted(extra)}")
        strong = _hits(every, roles.get("strong", ())) + _hits(header, roles.get("strong_header", ()))
        score = strong * STRONG + _hits(every, roles.get("weak", ())) * WEAK + _hits(every, roles.get("negative", ())) * NEGATIVE
        fits = F.lit(False)
        for holds, shift in (layout or {}).get(name, ()):
            held = F.coalesce(holds, F.lit(False))
            score = score + F.when(held, shift).otherwise(0.0)
            fits = fits | held if shift > 0 else fits
        out.append(F.struct(F.lit(name).alias("type"), score.cast("double").alias("score"), (strong > 0).alias("strong"), fits.alias("fits")))
    return F.array(*out)


def best_type(scores: Column) -> Column:
    """struct(label, confidence, score, margin, runner_up) out of ``type_scores``: the highest score, the first of equals; UNKNOWN
    where none is above zero. A strong hit makes SURE, others UNSURE; a layout that fits and a margin of CLEAR_MARGIN add to it."""
    def better(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | (b["score"] > a["score"]), b).otherwise(a)

    none = F.lit(None).cast("struct<type: string, score: double, strong: boolean, fits: boolean>")
    first = F.aggregate(scores, none, better)
    second = F.aggregate(F.filter(scores, lambda s: s["type"] != first["type"]), none, better)
    known, margin = first["score"] > 0, first["score"] - F.greatest(F.coalesce(second["score"], F.lit(0.0)), F.lit(0.0))
    confidence = F.when(first["strong"], SURE).otherwise(UNSURE) + F.when(first["fits"], FITTING).otherwise(0.0) + F.when(margin >= CLEAR_MARGIN, CLEAR).otherwise(0.0)
    return F.struct(
        F.when(known, first["type"]).otherwise("UNKNOWN").alias("label"), F.round(F.when(known, confidence).otherwise(FLOOR), 3).alias("confidence"), first["score"].alias("score"),
        F.when(known, margin).otherwise(0.0).alias("margin"), F.when(known & (second["score"] > 0), second["type"]).alias("runner_up"),
    )
