"""Text features and vector measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that tell what a tariff page is about, by subject in the order that breaks ties.
VOCABULARY = {
    "rates": ("rate", "kwh", "charge", "cents"),
    "riders": ("rider", "adjustment", "surcharge"),
    "legal": ("commission", "docket", "order", "license"),
    "contact": ("example.com", "@", "phone"),
}
#: Label and pattern of a text, first match wins.
SIGNATURES = (
    ("license", r"(?i)licensed under|permission is hereby"),
    ("table", r"\|"),
    ("shouting", r"[A-Z]{3,}!!"),
    ("decorated", r"[*%#$&]{3}"),
)


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a plain term."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def word_count(text: Column) -> Column:
    """Stretches of characters other than spaces and line ends."""
    return F.regexp_count(text, F.lit("[^ \\n]+"))


def vocabulary_counts(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    out = {}
    for subject, terms in VOCABULARY.items():
        total = occurrences(low, terms[0])
        for t in terms[1:]:
            total = total + occurrences(low, t)
        out[subject] = total
    return out


def first_signature(text: Column, first: int | None = None) -> Column:
    """Label of the first pattern found in a text (or its ``first`` characters), else plain."""
    head = text if first is None else F.substring(text, 1, first)
    out = F.lit("plain")
    for label, pattern in reversed(SIGNATURES):
        out = F.when(head.rlike(pattern), label).otherwise(out)
    return out


def size_band(n: Column) -> Column:
    return F.when(n < 50, "tiny").when(n < 200, "short").when(n < 1000, "medium").otherwise("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle, null for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
