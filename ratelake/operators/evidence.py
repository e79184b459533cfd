"""Evidence about documents: votes fused into an identity, and the lines that extracted rows were read from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import first_of
from .stages import staged

#: A code specific enough to identify a document, lengths of titles that may, and what each kind of evidence
#: adds to the confidence in an identity.
STRONG_CODE = r"^[A-Z]{2,5}-?\d{1,3}[A-Z]?$"
TITLE_LENGTHS = (5, 100)
CODE_WEIGHT, TITLE_WEIGHT, NAME_WEIGHT, CLASSIFIER_WEIGHT, CONSENSUS_WEIGHT = 0.30, 0.20, 0.15, 0.15, 0.20
SURE, CLEAR_MARGIN = 0.7, 0.15


def strong_codes(codes: Column) -> Column:
    """Distinct codes of an array that are specific enough, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.coalesce(c.rlike(STRONG_CODE), F.lit(False)))))


def telling_titles(titles: Column, blocked: Sequence[str] = ()) -> Column:
    """Distinct titles of an array in capitals, of a fitting length and not ``blocked``, sorted."""
    plain = F.transform(F.coalesce(titles, F.array().cast("array<string>")), lambda t: F.trim(F.upper(t)))
    low, high = TITLE_LENGTHS
    fits = lambda t: F.coalesce(F.length(t).between(low, high) & ~t.isin(*blocked), F.lit(False))
    return F.array_sort(F.array_distinct(F.filter(plain, fits)))


def signals(name: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Labels of the patterns (pattern, label) that a name has, in any case and in order."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(name.rlike(f"(?i){p}"), F.lit(label)) for p, label in rules))))


def identity_confidence(codes: Column, titles: Column, named: Column, classifier: Column, consensus: Column, margin: Column) -> Column:
    """0 to 1: strong codes, telling titles and name signals (arrays), a sure classifier, and a consensus that is sure and clear."""
    has = lambda a, w: F.when(F.size(a) > 0, w).otherwise(0.0)
    sure = lambda x: F.coalesce(x, F.lit(0.0))
    agreed = (sure(consensus) >= SURE) & (sure(margin) >= CLEAR_MARGIN)
    total = has(codes, CODE_WEIGHT) + has(titles, TITLE_WEIGHT) + has(named, NAME_WEIGHT) + F.when(sure(classifier) >= SURE, CLASSIFIER_WEIGHT).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(total + F.when(agreed, CONSENSUS_WEIGHT).otherwise(0.0), 3))


def fuse_votes(votes: DataFrame, keys: Sequence[str], source: str, label: str, confidence: str, order: Sequence[str | Column], weights: Mapping[str, float], other: float = 0.0) -> DataFrame:
    """What the latest vote of each source says about each key, put together: ``keys``, first, first_score, second,
    second_score, consensus (the winner's share of all points), margin (what its share has over the second's), voters
    (sources with points) and votes (all rows).

    Of a source's votes the first in ``order`` counts, also if it says nothing (a null label takes the source's vote away).
    A vote is worth its confidence (null: none, limited to 0 to 1) times the weight of its source, ``other`` for sources
    not named. Of equal labels the smaller comes first. A key whose votes have no points keeps nulls and zeros. Latest votes are
    found by key and source before they meet, so at most one row a source and key is gathered.
    """
    weight = F.lit(float(other))
    for name, w in weights.items():
        weight = F.when(F.col(source) == name, float(w)).otherwise(weight)
    counts = votes.groupBy(*keys, source).agg(F.count("*").alias("__n"))
    latest = first_of(votes, [*keys, source], order)
    points = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence).cast("double"))), F.lit(0.0)) * weight
    latest = latest.select(*keys, source, F.col(label).alias("__label"), F.when(F.col(label).isNull(), 0.0).otherwise(F.round(points, 9)).alias("__points"))
    both = counts.withColumns({"__label": F.lit(None).cast("string"), "__points": F.lit(0.0)}).unionByName(latest.withColumn("__n", F.lit(0)))
    held = both.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("__points") > 0, F.struct(F.col(source).cast("string").alias("s"), F.col("__label").alias("label"), F.col("__points").alias("points"))))).alias("cast"),
        F.sum("__n").alias("votes"),
    )
    # Sources in order, so that sums of decimals do not depend on who came first.
    start = F.create_map().cast("map<string, double>")
    added = lambda m, v: F.map_zip_with(m, F.create_map(v["label"], v["points"]), lambda k, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    scores = F.aggregate("cast", start, added)
    ranked = held.withColumn("scores", scores).withColumn(
        "places", F.array_sort(F.transform(F.map_entries("scores"), lambda e: F.struct((-e["value"]).alias("score"), e["key"].alias("label"))))
    )
    total = F.aggregate(F.col("cast.points"), F.lit(0.0), lambda a, x: a + x)
    at = lambda i, f: F.get("places", F.lit(i))[f]
    first, second = F.coalesce(-at(0, "score"), F.lit(0.0)), F.coalesce(-at(1, "score"), F.lit(0.0))
    share = lambda x: F.when(total > 0, x / total).otherwise(0.0)
    return ranked.select(
        *keys, at(0, "label").alias("first"), first.alias("first_score"), at(1, "label").alias("second"), second.alias("second_score"),
        share(first).alias("consensus"), share(first - second).alias("margin"), F.size("cast").alias("voters"), "votes",
    )


def plain_line(text: Column) -> Column:
    """A line in lower case, with one space for each run of white space and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def text_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, line (from 0), start (characters before it in the text), size and plain, for each line that is not blank."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    starts = F.aggregate(
        lines, F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.array_append(acc["at"], acc["n"]).alias("at"), (acc["n"] + F.length(x) + 1).alias("n")), lambda acc: acc["at"],
    )
    each = docs.select(key, F.posexplode(F.arrays_zip(lines.alias("x"), starts.alias("at"))).alias("line", "l"))
    found = each.select(key, "line", F.col("l.at").alias("start"), F.length("l.x").alias("size"), plain_line(F.col("l.x")).alias("plain"))
    return found.where("plain <> ''")


GRAM = 3
#: Quotes of a document that meet all its lines of fitting length; those of documents with more go by their rarest runs.
FEW_QUOTES = 8


def _grams(text: Column) -> Column:
    """Distinct runs of GRAM characters."""
    n = F.length(text) - GRAM + 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, i, F.lit(GRAM)))))


def locate_lines(quotes: DataFrame, lines: DataFrame, key: str, ident: str, quote: str, tolerance: float = 0.15) -> DataFrame:
    """The line of the same ``key`` that each quote was most likely read from: ``key``, ``ident``, line, start, size and
    distance (edits between the plain forms), for quotes with a line within ``tolerance`` edits a character of the quote, rounded down.

    ``lines`` is what ``text_lines`` gives. Of lines as close the first counts. Blank and null quotes match nothing; quotes
    of one ``key`` and ``ident`` are one. Where a document has up to FEW_QUOTES quotes, all its lines of a length in reach are candidates: that is
    linear in the lines, and explodes nothing. Where it has more, lines are candidates if they share one of the rarest 3 k + 1 three-letter runs of the quote (within its document),
    where k is the edits allowed: k edits break 3 k runs at most, so no match is lost. Quotes with fewer runs than that meet
    the lines of every length in reach. Edit distance is computed for candidates only, and given up beyond k.
    """
    # Of a quote given twice the smaller text counts.
    asked = quotes.where(F.col(key).isNotNull() & F.col(ident).isNotNull()).select(key, ident, plain_line(F.col(quote)).alias("quote")).where("quote <> ''").groupBy(key, ident).agg(F.min("quote").alias("quote"))
    asked = asked.withColumns({"n": F.length("quote"), "k": F.floor(F.length("quote") * tolerance).cast("int")})
    asked = staged(asked, "quotes")
    crowded = asked.groupBy(key).agg(F.count("*").alias("quotes")).where(F.col("quotes") > FEW_QUOTES).select(key)
    close = F.abs(F.length("plain") - F.col("n")) <= F.col("k")
    tried = lines.join(asked.join(crowded, key, "left_anti"), key).where(close)
    if not crowded.isEmpty():
        tried = tried.unionByName(_by_grams(asked.join(crowded, key, "left_semi"), lines, key, ident), allowMissingColumns=True)
    # The bound of levenshtein is one number for all rows, so lines out of reach are told apart afterwards.
    tried = tried.withColumn("distance", F.levenshtein("plain", "quote")).where("distance <= k")
    best = F.min_by(F.struct("line", "start", "size", "distance"), F.struct("distance", "line"))
    return tried.groupBy(key, ident).agg(best.alias("b")).select(key, ident, "b.*")


def _by_grams(asked: DataFrame, lines: DataFrame, key: str, ident: str) -> DataFrame:
    """Candidates of ``locate_lines`` by rare runs: rows of ``lines`` with ``ident``, quote and k."""
    asked = asked.withColumn("grams", _grams(F.col("quote"))).withColumn("need", F.col("k") * GRAM + 1)
    many = F.size("grams") >= F.col("need")
    near = lines.join(asked.select(key).distinct(), key, "left_semi").withColumn("n_line", F.length("plain"))
    grams = near.select(key, "line", "n_line", F.explode(_grams(F.col("plain"))).alias("gram"))
    ask = asked.where(many).select(key, ident, "n", "k", "need", F.explode("grams").alias("gram"))
    common = grams.join(ask.select(key, "gram").distinct(), [key, "gram"], "left_semi").groupBy(key, "gram").agg(F.count("*").alias("lines"))
    # A run that no line has is the rarest, and tells that its quote has at least one edit.
    rated = ask.join(common, [key, "gram"], "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    held = rated.groupBy(key, ident, "n", "k", "need").agg(F.sort_array(F.collect_list(F.struct("lines", "gram"))).alias("grams"))
    chosen = held.select(key, ident, "n", "k", F.explode(F.slice("grams", F.lit(1), F.col("need"))).alias("g")).where("g.lines > 0").select(key, ident, "n", "k", F.col("g.gram").alias("gram"))
    in_reach = F.abs(F.col("n_line") - F.col("n")) <= F.col("k")
    by_gram = chosen.join(grams, [key, "gram"]).where(in_reach).select(key, ident, "line").distinct()
    short = asked.where(~many).select(key, ident, F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - F.col("k")), F.col("n") + F.col("k"))).alias("n_line"))
    pairs = by_gram.unionByName(short.join(near.select(key, "line", "n_line"), [key, "n_line"]).select(key, ident, "line"))
    return pairs.join(near.drop("n_line"), [key, "line"]).join(asked.select(key, ident, "quote", "k", "n"), [key, ident])
