"""Queries over what texts speak for: flags, codes, and scanned text put right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.functions import parsing
from ratelake.operators import doctypes, flags
from ratelake.operators.documents import FINAL, PROPOSED

from .registry import query, table

#: The tables hold invented prose, so each text gets a line of the kind that these rules are about.
_LINES = (
    "It is hereby ordered that the proposed rates are approved by the Commission.", "Notice of proposed rulemaking; draft order pending approval", "DOCKET NO. E-2 Sub 1142, effective January 1, 2024, First Revised Leaf No. 60A and leaf no 7",
    "Privileged and confidential trade secret, SCHEDULE RES-28 (NC)", "Customer charge $14.00 per month, energy charge 10.3 cents per kWh", "filed in compliance with the order: compliance filing, RIDER EB",
    "redline: stricken text, new text inserted", "Effective: Sept 31 2023; R-TOU-CPP and SGS-TOUE-79, E-7", "effective as of Foo 1, 2020", "total bill; annual report required by order. LGS service", "present rates, Schedule THE", "",
)
_TEXT_SQL = f"coalesce(text, '') || chr(10) || [{', '.join(repr(x) for x in _LINES)}][doc_id % {len(_LINES)} + 1]"


def _text() -> Column:
    return F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.element_at(F.array(*map(F.lit, _LINES)), (F.col("doc_id") % len(_LINES) + 1).cast("int")))


def _points(marks: flags.Marks) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(x, '(?i){p}') THEN {w} ELSE 0 END" for p, w in marks)


def _bounded(name: str) -> str:
    _, sure, maybe, most, weak = flags.BOUNDS[name]
    label = f"CASE WHEN {name} >= {sure} THEN 'true' WHEN {name} >= {maybe} THEN 'false' ELSE 'unknown' END AS {name}"
    return f"{label}, CASE WHEN {name} >= {sure} THEN round(least(1.0::DOUBLE, {name} / {most}.0::DOUBLE), 6) WHEN {name} >= {maybe} THEN {weak}::DOUBLE ELSE 0 END AS {name}_confidence"


@query(f"""WITH t AS (SELECT doc_id, source, {_TEXT_SQL} AS x FROM documents),
    p AS (SELECT doc_id, source, x, {_points(FINAL)} AS f, {_points(PROPOSED)} AS p, {", ".join(f"{_points(marks)} AS {name}" for name, (marks, *_) in flags.BOUNDS.items())},
        regexp_extract_all(x, '(?i){flags.LEAF}', 1) AS leaves, trim(regexp_extract(x, '(?i){flags.DOCKET}', 1)) AS docket, string_split_regex(replace(regexp_extract(x, '(?i){flags.EFFECTIVE}', 1), ',', ' '), '\\s+') AS d FROM t),
    m AS (SELECT *, list_position({list(flags.MONTHS)!r}, CASE lower(d[1]) {" ".join(f"WHEN '{s}' THEN '{m}'" for s in flags.SHORT_MONTHS for m in flags.MONTHS if m[:3] == s[:3])} ELSE lower(d[1]) END) AS mm, try_cast(d[2] AS INTEGER) AS dd, try_cast(d[3] AS INTEGER) AS yy FROM p)
    SELECT doc_id, CASE WHEN f > p THEN 'true' WHEN p > 0 THEN 'false' ELSE 'unknown' END AS final, CASE WHEN f > p THEN 'false' WHEN p > 0 THEN 'true' ELSE 'unknown' END AS proposed,
        round(least(1.0::DOUBLE, greatest(f, p) / 15.0::DOUBLE), 6) AS direction_confidence, {", ".join(_bounded(n) for n in flags.BOUNDS)},
        CASE WHEN len(leaves) > 0 THEN 'true' ELSE 'unknown' END AS leaf_numbers, round(least(1.0::DOUBLE, len(list_distinct(leaves)) / 10.0::DOUBLE), 6) AS leaf_confidence,
        CASE WHEN docket <> '' THEN docket ELSE source END AS docket, CASE WHEN docket <> '' THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END AS docket_confidence,
        CASE WHEN mm > 0 AND dd BETWEEN 1 AND 31 AND yy BETWEEN 1900 AND 2099 THEN printf('%04d-%02d-%02d', yy, mm, dd) ELSE 'none' END AS effective,
        CASE WHEN len(leaves) > 0 THEN 'leaf-' || leaves[1] ELSE 'unknown' END AS family, CASE WHEN x ILIKE '%commission%' THEN 'COM' WHEN x ILIKE '%docket%' THEN 'DOC' ELSE 'unknown' END AS company FROM m""")
def document_flag_values(spark: SparkSession, d: str) -> DataFrame:
    """All flags and values of each whole text: final, proposed, redline, confidential, rate tables, compliance filing, leaves,
    docket, effective date, family and company."""
    docs = table(spark, d, "documents").select("doc_id", "source", _text().alias("x"))
    text, none = F.col("x"), F.lit(None).cast("string")
    final, proposed = flags.direction(text)
    rows = docs.select(
        "doc_id", final.alias("final"), proposed.alias("proposed"), *(flags.marked(text, n).alias(n) for n in flags.BOUNDS), flags.leaf_numbers(text, none).alias("leaves"),
        flags.docket_number(text, F.col("source")).alias("docket"), flags.effective_date(text, none).alias("effective"), flags.tariff_family(text, none).alias("family"),
        flags.company(text, [("commission", "COM"), ("docket", "DOC")], none).alias("company"),
    )
    both = [c for n in flags.BOUNDS for c in (F.col(f"{n}.label").alias(n), F.col(f"{n}.confidence").alias(f"{n}_confidence"))]
    return rows.select(
        "doc_id", F.col("final.label").alias("final"), F.col("proposed.label").alias("proposed"), F.col("final.confidence").alias("direction_confidence"), *both,
        F.col("leaves.label").alias("leaf_numbers"), F.col("leaves.confidence").alias("leaf_confidence"), F.col("docket.label").alias("docket"), F.col("docket.confidence").alias("docket_confidence"),
        F.col("effective.label").alias("effective"), F.col("family.label").alias("family"), F.col("company.label").alias("company"),
    )


_DENIED_SQL = ", ".join(f"'{c}'" for c in (*flags.NO_CODES, *flags.DOCKETS))
_TWO_SQL = ", ".join(f"'{c}'" for c in flags.SHORT_CODES if len(c) == 2)


@query(f"""WITH t AS (SELECT doc_id, {_TEXT_SQL} AS x FROM documents),
    c AS (SELECT doc_id, unnest(regexp_extract_all(x, '(?i){flags.PREFIXED}', 1)) AS c, 'explicit_prefix' AS source, 1 AS rank FROM t
        UNION ALL SELECT doc_id, unnest(regexp_extract_all(x, '{flags.COMPOUND}', 1)), 'compound', 2 FROM t),
    a AS (SELECT doc_id, upper(trim(c)) AS code, source, rank FROM c),
    f AS (SELECT * FROM a WHERE code NOT IN ({_DENIED_SQL}) AND NOT regexp_matches(code, '^R[0-9]+-[0-9]+$') AND NOT regexp_matches(code, '^[0-9]+$') AND length(code) BETWEEN 2 AND {flags.LONGEST_CODE} AND (length(code) <> 2 OR code IN ({_TWO_SQL}))
        UNION ALL SELECT doc_id, s, 'known_short', 3 FROM t, (SELECT unnest({list(flags.SHORT_CODES)!r}) AS s) WHERE regexp_matches(upper(list_last(string_split(x, chr(10)))), '\\b' || s || '\\b'))
    SELECT doc_id, code, arg_min(source, rank) AS source FROM f GROUP BY 1, 2""")
def schedule_code_sources(spark: SparkSession, d: str) -> DataFrame:
    """Codes of schedules in each whole text, with the evidence for them; the last line stands for a title."""
    docs = table(spark, d, "documents").select("doc_id", _text().alias("x"))
    title = F.element_at(F.split("x", "\n", -1), -1)
    found = docs.select("doc_id", F.explode(flags.schedule_codes(F.col("x"), title)).alias("c"))
    return found.select("doc_id", "c.code", "c.source")


@query()
def scan_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with the marks of a bad scan put in and taken out again: characters before and after, and a digest. The rules
    look behind and ahead, which this SQL cannot; the tests run them in Python over the same texts."""
    rows = table(spark, d, "documents").select("doc_id", damaged_scan(F.coalesce("text", F.lit(""))).alias("x")).withColumn("y", parsing.repair_scan(F.col("x")))
    return rows.select("doc_id", F.length("x").alias("n_before"), F.length("y").alias("n_after"), F.md5(F.col("y").cast("binary")).alias("digest"))


def damaged_scan(text: Column) -> Column:
    """A text as a bad scan might have it."""
    out = F.regexp_replace(text, "\\n", " ■■\\n-----\\n S12.50 f!/kWh\\n Mav 3 O.75   1.5 0\\n")
    return F.concat(out, F.lit(" Januarv 1arge 14.\n00 0.0067 tf /kWh £ 7? kwh (l.25 $ 3.10"))


#: What tells the kinds of texts in the tables apart, by role.
_TYPES = {
    "ORDER": {"strong": (r"\bordered\b", r"so\s+ordered"), "weak": (r"commission", r"approv"), "negative": (r"\bdraft\b", r"redline")},
    "TARIFF": {"strong_header": (r"leaf\s+no", r"schedule\s+[a-z]+"), "strong": (r"\bschedule\s+[A-Z]+-[0-9]+",), "weak": (r"charge", r"per\s+(?:month|kwh)", r"effective"), "negative": (r"in\s+the\s+matter",)},
    "LETTER": {"strong_header": (r"^dear\b",), "weak": (r"\bfree\b", r"permission", r"[0-9]{3}-[0-9]{4}"), "negative": (r"\bcharge\b",)},
    "FILING": {"strong": (r"compliance\s+filing", r"docket\s+no"), "weak": (r"compliance", r"report")},
}


def _count_sql(text: str, patterns: tuple) -> str:
    return " + ".join(f"len(regexp_extract_all({text}, '(?i){p}'))" for p in patterns) or "0"


def _type_sql(name: str) -> str:
    r = _TYPES[name]
    strong = f"({_count_sql('x', r.get('strong', ()))} + {_count_sql('h', r.get('strong_header', ()))})"
    shift = {"TARIFF": "CASE WHEN n_lines >= 8 THEN 1.0 ELSE 0 END", "LETTER": "CASE WHEN n_lines >= 5 THEN -1.5 ELSE 0 END"}.get(name, "0")
    fits = "n_lines >= 8" if name == "TARIFF" else "false"
    score = f"CAST({strong} * 3.0 + ({_count_sql('x', r.get('weak', ()))}) * 1.0 - ({_count_sql('x', r.get('negative', ()))}) * 2.0 + {shift} AS DOUBLE)"
    return f"SELECT doc_id, '{name}' AS type, {list(_TYPES).index(name)} AS place, {score} AS score, {strong} > 0 AS strong, {fits} AS fits FROM t"


@query(f"""WITH s AS (SELECT doc_id, {_TEXT_SQL} AS y, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    t AS (SELECT doc_id, list_last(string_split(y, chr(10))) || chr(10) || y || chr(10) || lines[len(lines)] AS x, list_last(string_split(y, chr(10))) || chr(10) || substring(y, 1, 120) AS h, len(lines) AS n_lines FROM s),
    a AS ({" UNION ALL ".join(map(_type_sql, _TYPES))}),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS k, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS next, lead(type) OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS second FROM a)
    SELECT doc_id, CASE WHEN score > 0 THEN type ELSE 'UNKNOWN' END AS label, score, CASE WHEN score > 0 THEN score - greatest(next, 0) ELSE 0 END AS margin, CASE WHEN score > 0 AND next > 0 THEN second END AS runner_up,
        CAST(round(CASE WHEN score > 0 THEN CASE WHEN strong THEN 0.8 ELSE 0.5 END + CASE WHEN fits THEN 0.05 ELSE 0 END + CASE WHEN score - greatest(next, 0) >= 3 THEN 0.1 ELSE 0 END ELSE 0.2 END, 3) AS DOUBLE) AS confidence FROM r WHERE k = 1""")
def document_types_by_role(spark: SparkSession, d: str) -> DataFrame:
    """The type of each whole text by strong, header, weak and negative patterns and by layout, with its margin over the next."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    docs = table(spark, d, "documents").select("doc_id", _text().alias("x"), F.element_at(lines, -1).alias("last"), F.size(lines).alias("n_lines"))
    title = F.element_at(F.split("x", "\n", -1), -1)
    layout = {"TARIFF": [(F.col("n_lines") >= 8, 1.0)], "LETTER": [(F.col("n_lines") >= 5, -1.5)]}
    rows = docs.select("doc_id", doctypes.type_scores(title, F.col("x"), F.col("last"), _TYPES, layout).alias("scores"))
    return rows.select("doc_id", doctypes.best_type(F.col("scores")).alias("b")).select("doc_id", "b.label", "b.score", "b.margin", "b.runner_up", "b.confidence")
