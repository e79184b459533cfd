"""Flags and values that a document's text speaks for: weighted marks, and what is found by pattern, with a confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .documents import FINAL, PROPOSED, marker_points
from .patterns import may_match
from .statuses import first_of_rules

Marks = Sequence[tuple[str, int]]

#: Marks of each flag (any case, each counts once) with weights, and points from which a flag is true or false,
#: the points of full confidence, and the confidence of a false one.
REDLINE: Marks = (
    (r"(?:marked|redline|red\s*line)", 2), (r"(?:proposed|existing|present)\s+(?:rates?|charges?)", 1), (r"(?:strike|stricken|strikethrough|deleted)", 3),
    (r"(?:inserted|added|new\s+text|underline)", 2), (r"(?:increase|decrease)\s+(?:from|to)\s+(?:[$]|¢)", 1),
)
CONFIDENTIAL: Marks = (
    (r"confidential", 5), (r"proprietary", 4), (r"protected\s+(?:material|information)", 4), (r"trade\s+secret", 4),
    (r"(?:subject\s+to|under)\s+protective\s+(?:order|agreement)", 3), (r"not\s+for\s+(?:public\s+)?disclosure", 3), (r"privileged\s+(?:and|&)\s+confidential", 5),
)
RATE_TABLES: Marks = (
    (r"¢/kWh|cents\s+per\s+k(?:ilo)?w(?:att)?[-\s]?h(?:our)?", 4), (r"[$]\s*[0-9]+\.?[0-9]*\s*(?:per|/)\s*(?:month|kwh|kw|day)", 3), (r"(?:customer|basic\s+facility)\s+(?:charge|fee)", 3),
    (r"(?:energy|fuel|demand|distribution)\s+charge", 3), (r"rate\s+(?:schedule|class|code)\s*[:;]", 2), (r"(?:monthly|annual|daily)\s+rate", 2), (r"total\s+(?:monthly\s+)?bill", 2),
)
COMPLIANCE: Marks = (
    (r"compliance\s+(?:filing|report|submission)", 5), (r"filed\s+(?:in|pursuant\s+to)\s+(?:compliance|order)", 4), (r"pursuant\s+to\s+(?:commission\s+)?order", 3),
    (r"(?:annual|quarterly|monthly)\s+(?:compliance\s+)?report", 3), (r"required\s+by\s+(?:order|the\s+commission)", 2), (r"in\s+compliance\s+with", 4),
)
#: name: marks, true from, false from, points of full confidence, confidence of a false one.
BOUNDS = {"redline": (REDLINE, 4, 1, 10, 0.3), "confidential": (CONFIDENTIAL, 5, 2, 20, 0.2), "rate_tables": (RATE_TABLES, 5, 2, 15, 0.3), "compliance_filing": (COMPLIANCE, 5, 2, 15, 0.3)}
DIRECTION_POINTS, LEAVES, TABLE_POINTS = 15, 10, 3
LEAF = r"leaf\s+no\.?\s*([0-9]+[A-Za-z]?)"
DOCKET = r"(?:DOCKET|E-[27])\s*(?:NO\.?)?\s*([A-Z]-[0-9]+\s*Sub\s*[0-9]+)"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SHORT_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")
EFFECTIVE = rf"effective\s*(?:as\s+of|on|date)?:?\s*((?:{'|'.join((*MONTHS, *SHORT_MONTHS))})\s+[0-9]{{1,2}},?\s+[0-9]{{4}})"


def _said(label: Column, confidence: Column) -> Column:
    return F.struct(label.alias("label"), F.round(confidence, 6).alias("confidence"))


def direction(text: Column) -> tuple[Column, Column]:
    """final and proposed, opposites of each other: which marks weigh more; equal ones speak for proposed, none for unknown."""
    final, proposed = marker_points(text, FINAL), marker_points(text, PROPOSED)
    wins = final > proposed
    confidence = F.least(F.lit(1.0), F.when(wins, final).otherwise(proposed) / DIRECTION_POINTS)
    is_final = first_of_rules([(wins, "true"), (proposed > 0, "false")], "unknown")
    is_proposed = first_of_rules([(wins, "false"), (proposed > 0, "true")], "unknown")
    return _said(is_final, confidence), _said(is_proposed, confidence)


def marked(text: Column, name: str, more: Column | None = None) -> Column:
    """One of the flags of BOUNDS as struct(label, confidence); ``more`` points are added to those of the marks."""
    marks, sure, maybe, most, weak = BOUNDS[name]
    points = marker_points(text, marks) if more is None else marker_points(text, marks) + more
    label = first_of_rules([(points >= sure, "true"), (points >= maybe, "false")], "unknown")
    return _said(label, F.when(points >= sure, F.least(F.lit(1.0), points / most)).when(points >= maybe, weak).otherwise(0.0))


def _gated(text: Column, pattern: str) -> Column:
    """The text where it has what the pattern requires, else an empty one (null stays): the pattern has nothing to search then."""
    may = may_match(text, pattern)
    return text if may is None else F.when(may | text.isNull(), text).otherwise("")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(_gated(text, pattern), F.lit(f"(?i){pattern}"), F.lit(1))


def _first(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(_gated(text, pattern), f"(?i){pattern}", group)


def leaf_numbers(text: Column, known: Column) -> Column:
    """true where the text names leaves, else where one is ``known``."""
    n = F.size(F.array_distinct(_all(text, LEAF)))
    held = known.isNotNull() & (known != "")
    return _said(first_of_rules([((n > 0) | held, "true")], "unknown"), F.when(n > 0, F.least(F.lit(1.0), n / LEAVES)).when(held, 0.9).otherwise(0.0))


def _found_or_known(found: Column, sure: float, known: Column, less: float, otherwise: str) -> Column:
    """What a text says, else what is known, else ``otherwise``; nulls and blanks say nothing."""
    found, known = F.nullif(found, F.lit("")), F.nullif(known, F.lit(""))
    return _said(F.coalesce(found, known, F.lit(otherwise)), F.when(found.isNotNull(), sure).when(known.isNotNull(), less).otherwise(0.0))


def docket_number(text: Column, known: Column) -> Column:
    return _found_or_known(F.trim(_first(text, DOCKET, 1)), 0.95, known, 0.7, "unknown")


def effective_date(text: Column, known: Column) -> Column:
    """The first date that follows the word effective, as yyyy-mm-dd; days beyond 31 and years outside 1900 to 2099 are none."""
    parts = F.split(F.translate(_first(text, EFFECTIVE, 1), ",", " "), r"\s+")
    names = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)), *(F.lit(x) for m in SHORT_MONTHS if m != "may" for x in (m, [n[:3] for n in MONTHS].index(m[:3]) + 1)))
    month = F.try_element_at(names, F.lower(F.get(parts, 0)))
    day, year = F.get(parts, 1).try_cast("int"), F.get(parts, 2).try_cast("int")
    date = F.when(month.isNotNull() & day.between(1, 31) & year.between(1900, 2099), F.format_string("%04d-%02d-%02d", year, month, day))
    return _found_or_known(date, 0.9, known, 0.5, "none")


def tariff_family(text: Column, known: Column) -> Column:
    """The family that is known, else one named after the first leaf in the text."""
    leaf = F.get(_all(text, LEAF), 0)
    held = known.isNotNull() & (known != "")
    return _said(F.when(held, known).when(leaf.isNotNull(), F.concat(F.lit("leaf-"), leaf)).otherwise("unknown"), F.when(held, 0.9).when(leaf.isNotNull(), 0.4).otherwise(0.0))


def company(text: Column, names: Sequence[tuple[str, str]], known: Column) -> Column:
    """The company (pattern, code) whose name in the text is longest, the first of equals; a ``known`` code of the list where none is named."""
    lengths = [F.length(_first(text, p, 0)) for p, _ in names]
    best = F.greatest(*lengths) if len(lengths) > 1 else lengths[0]
    found = F.coalesce(*(F.when((n == best) & (n > 0), code) for n, (_, code) in zip(lengths, names, strict=True)))
    held = F.when(F.upper(known).isin(*{c for _, c in names}), F.upper(known))
    return _said(F.coalesce(found, held, F.lit("unknown")), F.when(found.isNotNull(), F.least(F.lit(1.0), best / 50.0)).when(held.isNotNull(), 0.7).otherwise(0.0))


#: Words that look like codes and are none, codes of dockets, and short codes that are codes all the same.
NO_CODES = (
    "NC NORTH AVAILABILITY APPLICABILITY ADJUSTMENT ADJUSTMENTS ENERGY LLC TYPE OF SERVICE MONTHLY RATE RATES RIDER RIDERS SCHEDULE SCHEDULES TARIFF PAGE LEAF REVISED ORIGINAL SUPERSEDING "
    "COMMISSION DOCKET EXHIBIT EFFECTIVE DATE FOR AND THE ALL ANY MAY INC SUB TOTAL BASE SUMMARY FUEL TAX TIME-OF-USE ALL-ENERGY"
).split()
DOCKETS = "E-1 E-2 E-3 E-4 E-4-E E-5 E-7 E-22 E-100 G-1 G-2 G-3 G-6 M-100 M-1000".split()
SHORT_CODES = "RS RES PL PG PS PV WC EB BA JAA MFS SGS LGS EE OS OSM STS EDR SLR FCAR REPS CEPS".split()
PREFIXED = r"\b(?:SCHEDULE|RIDER|RATE\s+SCHEDULE)\s+([A-Z][A-Z0-9]{0,2}(?:-[A-Z0-9]+){0,3})(?:\s*\(NC\))?\b"
COMPOUND = r"\b([A-Z][A-Z0-9]*(?:-[A-Z0-9]+){1,4})\b"
LONGEST_CODE = 25
#: A word boundary as in ASCII, whatever letters stand around.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def schedule_codes(text: Column, title: Column, denied: Sequence[str] = ()) -> Column:
    """Codes of schedules in a text, each once, best evidence first, as array of struct(code, source): those after schedule
    or rider (explicit_prefix), those with dashes (compound), and short ones that are known where the ``title`` has them (known_short).

    ``denied`` adds to the words that are no codes. Dockets, rules of the commission (R8-55), numbers, single letters, two letters that are not known, and
    codes longer than LONGEST_CODE are left out.
    """
    no = [*NO_CODES, *DOCKETS, *(d.upper() for d in denied)]
    two = [c for c in SHORT_CODES if len(c) == 2]

    def fits(c: Column) -> Column:
        return ~c.isin(*no) & ~c.rlike(r"^R[0-9]+-[0-9]+$") & ~c.rlike("^[0-9]+$") & F.length(c).between(2, LONGEST_CODE) & ((F.length(c) != 2) | c.isin(*two))

    def found(pattern: str, source: str, start: str, required: Column) -> Column:
        # The first edge is the beginning of a word, and is looked for only where the ``start`` of a match stands.
        exact = f"{start}(?<![A-Za-z0-9_])" + pattern.removeprefix(r"\b").replace(r"\b", _EDGE)
        raw = F.regexp_extract_all(F.when(required | text.isNull(), text).otherwise(""), F.lit(exact), F.lit(1))
        return F.transform(F.filter(F.transform(raw, lambda c: F.upper(F.trim(c))), fits), lambda c: F.struct(c.alias("code"), F.lit(source).alias("source")))

    short = F.array_compact(F.array(*(F.when(F.upper(title).rlike(f"{_EDGE}{c}{_EDGE}"), F.struct(F.lit(c).alias("code"), F.lit("known_short").alias("source"))) for c in SHORT_CODES)))
    named = found(PREFIXED, "explicit_prefix", "(?i)(?=[SR])", may_match(text, PREFIXED))
    dashed = found(COMPOUND, "compound", "(?=[A-Z])", text.contains("-"))
    every = F.concat(named, dashed, short)
    start = F.array().cast("array<struct<code: string, source: string>>")
    return F.aggregate(every, start, lambda acc, c: F.when(F.exists(acc, lambda x: x["code"] == c["code"]), acc).otherwise(F.array_append(acc, c)))
