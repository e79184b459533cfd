"""Many patterns at once over whole texts: what a pattern requires goes into an index, so that a text meets only patterns that can match."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statuses import first_of_rules

GRAM = 3
#: Rows of the index that are broadcast at most (some 60 bytes each); beyond that, a shuffle join.
BROADCAST_ROWS = 200_000
#: Shares of cases that must hold, cases that are enough to tell, and matches of other texts that are too many.
CASES_HOLD, CASES_FAIL, CASES, FALSE_POSITIVES = 0.8, 0.25, 3, 3


def required_any(pattern: str) -> list[str]:
    """Words (ASCII letters and digits, lower case) of which any match of ``pattern`` holds at least one, in whatever case; none if no
    such words are known."""
    from re import _constants as c
    from re import _parser as parser

    def words(tokens: Iterable) -> list[str]:
        choices, run = [], ""
        for op, value in tokens:
            if op is c.LITERAL and chr(value).isascii() and chr(value).isalnum():
                run += chr(value).lower()
                continue
            choices.append([run])
            run = ""
            if op is c.SUBPATTERN:
                choices.append(words(value[3]))
            elif op is c.BRANCH:
                each = [words(b) for b in value[1]]
                choices.append([w for e in each for w in e] if all(each) else [])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and value[0] >= 1:
                choices.append(words(value[2]))
        choices.append([run])
        fit = [ch for ch in choices if ch and all(ch)]
        # The longer the shortest word, the fewer texts have one.
        return max(fit, key=lambda ch: (min(map(len, ch)), -len(ch)), default=[])

    return sorted(set(words(parser.parse(pattern))))


def may_match(text: Column, pattern: str) -> Column | None:
    """Whether a text has what ``pattern`` requires, in whatever case: cheaper than the pattern by far. None if nothing is required."""
    low = F.lower(text)
    held = None
    for word in required_any(pattern):
        has = low.contains(word)
        held = has if held is None else held | has
    return held


def has_pattern(text: Column, pattern: str) -> Column:
    """``text.rlike`` of the pattern in any case; the pattern runs only over texts that have what it requires."""
    may, found = may_match(text, pattern), text.rlike(f"(?i){pattern}")
    return found if may is None else may & found


def required_literal(pattern: str) -> str | None:
    """The longest run of letters and digits (ASCII, lower case) that any match of ``pattern`` holds, in whatever case; '' if
    there is none, None if the pattern cannot be read."""
    from re import _constants as c
    from re import _parser as parser

    try:
        re.compile(pattern)
        parsed = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    best, run = "", ""

    def end() -> None:
        nonlocal best, run
        best, run = max(best, run, key=len), ""

    def walk(tokens: Iterable) -> None:
        nonlocal run
        for op, value in tokens:
            if op is c.LITERAL and chr(value).isascii() and chr(value).isalnum():
                run += chr(value).lower()
            elif op is c.SUBPATTERN:
                walk(value[3])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and value[0] >= 1:
                walk(value[2])
                end()  # what follows comes after the last repetition, whose end may be cut by a next one
            elif op is c.ATOMIC_GROUP:
                walk(value)
            elif op is not c.AT:
                end()

    walk(parsed)
    end()
    return best


def _grams_of(word: str) -> set[str]:
    return {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)}


def _text_grams(text: Column) -> Column:
    """Distinct runs of GRAM letters and digits inside the words of a text, in lower case."""
    words = F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))
    long = F.filter(words, lambda w: F.length(w) >= GRAM)
    return F.array_distinct(F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - GRAM + 1), lambda i: F.substr(w, i, F.lit(GRAM))))))


def pattern_table(spark, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """name, pattern, literal and problem (null, rejected_invalid_regex or rejected_no_anchor) of each pattern (name, pattern)."""
    rows = []
    for name, pattern in patterns:
        literal = required_literal(pattern)
        problem = "rejected_invalid_regex" if literal is None else "rejected_no_anchor" if len(literal) < GRAM else None
        rows.append((name, pattern, literal, problem))
    return spark.createDataFrame(rows, "name string, pattern string, literal string, problem string")


def candidates(docs: DataFrame, patterns: Sequence[tuple[str, str]], id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and name of each text with all three-letter runs that a match of the pattern needs; patterns without such
    runs, and those that cannot be read, have no candidates. Ids tell texts apart and are not null."""
    index = [(gram, name, len(grams)) for name, p in patterns for grams in [_grams_of(required_literal(p) or "")] for gram in sorted(grams)]
    side = docs.sparkSession.createDataFrame(index, "gram string, name string, need int")
    side = F.broadcast(side) if len(index) <= BROADCAST_ROWS else side
    grams = docs.where(F.col(text_col).isNotNull()).select(id_col, F.explode(_text_grams(F.col(text_col))).alias("gram"))
    met = grams.join(side, "gram").groupBy(id_col, "name").agg(F.count("*").alias("has"), F.max("need").alias("need"))
    return met.where("has = need").select(id_col, "name")


def matches(docs: DataFrame, patterns: Sequence[tuple[str, str]], id_col: str, text_col: str) -> DataFrame:
    """``id_col``, name and matches (their number, zero for candidates that do not match) of each candidate. Exactly the texts
    that trying every usable pattern would find have matches above zero."""
    listed = pattern_table(docs.sparkSession, patterns).select("name", "pattern")
    found = candidates(docs, patterns, id_col, text_col).join(F.broadcast(listed) if len(patterns) <= BROADCAST_ROWS else listed, "name")
    return found.join(docs.select(id_col, text_col), id_col).select(id_col, "name", F.regexp_count(text_col, F.col("pattern")).cast("bigint").alias("matches"))


def validate(docs: DataFrame, patterns: Sequence[tuple[str, str]], cases: DataFrame, own: Column, id_col: str, text_col: str) -> DataFrame:
    """One row for each pattern: name, literal, candidates, matched (texts), matches, own_matched and false_positives (matched
    texts where ``own``, a condition over name and the columns of ``docs``, holds or does not), positive_rate and
    negative_rate (shares of the cases (name, text, positive) that turn out as they should, null without any) and status.

    Patterns that cannot be read or require no run of three letters or digits are refused and tried on nothing. Then more
    false positives than FALSE_POSITIVES refuse a pattern, matched texts of its own without any accept it, and
    cases accept it as far as they go; failing cases refuse it, and the rest is left to people.
    """
    listed = pattern_table(docs.sparkSession, patterns)
    met = matches(docs, patterns, id_col, text_col)
    rest = [c for c in docs.columns if c not in (text_col, "name", "matches")]
    judged = met.join(docs.select(*rest), id_col).withColumn("__own", F.coalesce(own, F.lit(False)))
    hit = F.col("matches") > 0
    counts = judged.groupBy("name").agg(
        F.count("*").alias("candidates"), F.count_if(hit).alias("matched"), F.sum("matches").alias("matches"),
        F.count_if(hit & F.col("__own")).alias("own_matched"), F.count_if(hit & ~F.col("__own")).alias("false_positives"),
    )
    tried = cases.join(listed.where("problem IS NULL").select("name", "pattern"), "name").withColumn("right", F.rlike(F.col("text"), F.col("pattern")) == F.col("positive"))
    share = lambda side: F.avg(F.when(F.col("positive") == side, F.coalesce(F.col("right"), F.lit(False)).cast("double")))
    rates = tried.groupBy("name").agg(share(True).alias("positive_rate"), share(False).alias("negative_rate"), F.count_if("positive").alias("n_positive"), F.count_if(~F.col("positive")).alias("n_negative"))
    rows = listed.join(counts, "name", "left").join(rates, "name", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    sure = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    holds = (n("n_positive") + n("n_negative") >= CASES) & (sure("positive_rate") >= CASES_HOLD) & (sure("negative_rate") >= CASES_HOLD)
    status = F.coalesce(
        "problem",
        first_of_rules(
            [
                (n("false_positives") > FALSE_POSITIVES, "rejected_false_positive"), ((n("own_matched") > 0) & (n("false_positives") == 0), "accepted_candidate"), (holds, "accepted_synthetic"),
                ((n("n_negative") >= CASES) & (sure("negative_rate") <= CASES_FAIL), "rejected_false_positive"), ((n("n_positive") >= CASES) & (sure("positive_rate") <= CASES_FAIL), "rejected_no_gain"),
            ],
            "needs_human_review",
        ),
    )
    return rows.select("name", "literal", *(n(c).alias(c) for c in ("candidates", "matched", "matches", "own_matched", "false_positives")), "positive_rate", "negative_rate", status.alias("status"))
