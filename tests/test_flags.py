"""Flags, codes and scan repairs by hand, and the repairs in Python over whole texts."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from ratelake.functions import parsing
from ratelake.operators import flags
from ratelake.plans import flag_queries

D = "/root/testdata/sf0.001"


def said(spark, text, use, known=None):
    df = spark.createDataFrame([(text, known)], "text string, known string")
    r = df.select(use(F.col("text"), F.col("known")).alias("x")).first()["x"]
    return r["label"], r["confidence"]


@pytest.mark.parametrize(
    "text, final, proposed",
    [("IT IS HEREBY ORDERED. So ordered", ("true", 0.6), "false"), ("a draft order pending approval", ("false", 0.4), "true"), ("final order, so ordered, draft order", ("true", 0.6), "false"), ("nothing", ("unknown", 0.0), "unknown"), ("", ("unknown", 0.0), "unknown"), ("approved by the commission", ("true", 0.2), "false"), ("notice of proposed rulemaking", ("false", 0.2), "true")],
)
def test_direction(spark, text, final, proposed):
    assert said(spark, text, lambda t, k: flags.direction(t)[0]) == final
    assert said(spark, text, lambda t, k: flags.direction(t)[1])[0] == proposed


@pytest.mark.parametrize(
    "name, text, want",
    [
        ("redline", "redline with stricken words", ("true", 0.5)), ("redline", "text deleted", ("false", 0.3)), ("redline", "present charges", ("false", 0.3)), ("confidential", "Confidential", ("true", 0.25)),
        ("confidential", "trade secret", ("false", 0.2)), ("confidential", "privileged and confidential, proprietary", ("true", 0.7)), ("rate_tables", "customer charge of $ 14.00 per month", ("true", 0.4)),
        ("rate_tables", "monthly rate", ("false", 0.3)), ("compliance_filing", "this compliance filing, in compliance with", ("true", 0.6)), ("compliance_filing", "required by order", ("false", 0.3)), ("compliance_filing", "x", ("unknown", 0.0)),
    ],
)
def test_marked_flags(spark, name, text, want):
    assert said(spark, text, lambda t, k: flags.marked(t, name)) == want


def test_points_of_native_tables_count(spark):
    assert said(spark, "total bill", lambda t, k: flags.marked(t, "rate_tables", F.lit(flags.TABLE_POINTS))) == ("true", 0.333333)


def test_values(spark):
    assert said(spark, "LEAF NO. 12 and Leaf No 7a, leaf no. 12", flags.leaf_numbers) == ("true", 0.2)
    assert said(spark, "none", flags.leaf_numbers, "5") == ("true", 0.9) and said(spark, "none", flags.leaf_numbers, "") == ("unknown", 0.0)
    assert said(spark, "Docket No. E-7 Sub 999 of", flags.docket_number) == ("E-7 Sub 999", 0.95)
    assert said(spark, "no docket", flags.docket_number, "E-2 Sub 1") == ("E-2 Sub 1", 0.7)
    assert said(spark, "Effective as of Sept 5, 2021.", flags.effective_date) == ("2021-09-05", 0.9)
    assert said(spark, "effective May 45, 2021", flags.effective_date, "2020-01-01") == ("2020-01-01", 0.5)
    assert said(spark, "effective date: January 3 1850", flags.effective_date) == ("none", 0.0)
    assert said(spark, "leaf no. 601", flags.tariff_family) == ("leaf-601", 0.4) and said(spark, "leaf no. 601", flags.tariff_family, "fam") == ("fam", 0.9)
    names = [("alpha energy", "A"), ("alpha energy partners", "AP"), ("beta", "B")]
    assert said(spark, "Alpha Energy Partners and beta", lambda t, k: flags.company(t, names, k)) == ("AP", 0.42)
    assert said(spark, "nobody", lambda t, k: flags.company(t, names, k), "b") == ("B", 0.7) and said(spark, "nobody", lambda t, k: flags.company(t, names, k), "zz")[0] == "unknown"
    assert said(spark, None, flags.effective_date) == ("none", 0.0)


def test_schedule_codes(spark):
    text = "Rate Schedule RES-28 (NC), rider EB and rider of; SCHEDULE THE; R-TOU-CPP under E-2 and R8-55, res-28 again; RES-28; Time-of-Use TIME-OF-USE 12-34"
    df = spark.createDataFrame([(text, "LGS for PG, XX")], "t string, h string")
    got = [tuple(r) for r in df.select(flags.schedule_codes(F.col("t"), F.col("h"), ["pg"]).alias("c")).first()["c"]]
    assert got == [("RES-28", "explicit_prefix"), ("EB", "explicit_prefix"), ("R-TOU-CPP", "compound"), ("PG", "known_short"), ("LGS", "known_short")]


def test_codes_are_not_searched_without_their_words(spark):
    docs = spark.createDataFrame([("Rider\nschedule ab-1x (NC) a RES-28 B-1, xA-1 A-1_ \u00e9B-2 schedulee C",), ("none of them",), (None,)], "t string")
    got = docs.select(flags.schedule_codes(F.col("t"), F.lit("")).alias("c"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan or "contains" in plan.lower()
    found = [None if r["c"] is None else [tuple(x) for x in r["c"]] for r in got.collect()]
    assert found == [[("AB-1X", "explicit_prefix"), ("RES-28", "compound"), ("B-1", "compound"), ("B-2", "compound")], [], None]


def test_patterns_run_only_where_their_words_are(spark):
    from ratelake.operators import documents, patterns

    every = [p for marks in (documents.FINAL, documents.PROPOSED, *(m for m, *_ in flags.BOUNDS.values())) for p, _ in marks]
    every += [flags.LEAF, flags.DOCKET, flags.EFFECTIVE, flags.PREFIXED, "commission"]
    assert sum(not patterns.required_any(p) for p in every) <= 2 and patterns.required_any(r"(?:a|[0-9])+x?") == []
    texts = [r["x"] for r in spark.read.parquet(f"{D}/documents.parquet").select(flag_queries._text().alias("x")).collect()]
    for p in every:
        words = patterns.required_any(p)
        hits = [t for t in texts if re.search(p, t, re.I | re.A)]
        assert not words or all(any(w in t.lower() for w in words) for t in hits)
    df = spark.createDataFrame([("K\u212aWH SO ORDERED",), ("",), (None,)], "t string")
    got = [r["y"] for r in df.select(patterns.has_pattern(F.col("t"), r"so\s+ordered").alias("y")).collect()]
    assert got == [True, False, None]


def python_repair(text):
    step = lambda t, pairs: [t := re.sub(p, r.replace(r"\$", "$").replace("$1", r"\1").replace("$2", r"\2") if r != r"\$$1" else r"$\1", t) for p, r in pairs][-1]
    out = step(text, parsing.SCAN_NOISE)
    for wrong, right in parsing.SCAN_WORDS.items():
        out = re.sub(rf"\b{wrong}\b", right, out)
    return step(out, parsing.SCAN_REPAIRS).strip(" \t\n\r\f\x0b")


def test_repairs_equal_python_over_whole_texts(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    raw = {r["doc_id"]: r["x"] for r in docs.select("doc_id", flag_queries.damaged_scan(F.coalesce("text", F.lit(""))).alias("x")).collect()}
    got = {r["doc_id"]: (r["n_before"], r["n_after"], r["digest"]) for r in flag_queries.scan_repairs(spark, D).collect()}
    want = {i: (len(x), len(y := python_repair(x)), hashlib.md5(y.encode()).hexdigest()) for i, x in raw.items()}
    assert got == want


def test_repairs_grow_with_the_text(spark):
    df = spark.createDataFrame([("Mav and Julv. " * 20000,)], "x string")
    began = time.time()
    got = df.select(parsing.repair_scan(F.col("x")).alias("y")).first()["y"]
    assert got == ("May and July. " * 20000).strip() and time.time() - began < 20


@pytest.mark.parametrize(
    "raw, fixed",
    [("Mav 1, Julv 2 and Mave", "May 1, July 2 and Mave"), ("$14.\n00 and 1,\n234.56", "$14.00 and 1,234.56"), ("S0.50 is $ 3.10", "$0.50 is $3.10"), ("12.5? per kWh", "12.5¢ per kWh"), ("0.0067 f!/kWh", "0.0067¢/kWh"), ("1.25 0\nnext", "1.25¢\nnext"), ("(O.50) (l.25) I.5", "(0.50) (1.25) 1.5"), ("a\n■■■───\nb", "a\n\nb"), ("", ""), (None, None)],
)
def test_repairs_by_hand(spark, raw, fixed):
    got = spark.createDataFrame([(raw,)], "x string").select(parsing.repair_scan(F.col("x")).alias("y")).first()["y"]
    assert got == fixed


def test_types_by_role(spark):
    from ratelake.operators import doctypes

    rules = {"A": {"strong": ("alpha",), "negative": ("stop",)}, "B": {"strong_header": ("beta",), "weak": ("beta", "gamma")}, "C": {"weak": ("gamma",)}}
    rows = [("", "alpha alpha", ""), ("beta", "", None), ("", "x" * 130 + " beta", ""), ("", "gamma", ""), ("", "alpha stop stop", "gamma"), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, f string, l string")
    layout = {"C": [(F.col("i") == 3, 1.0)], "A": [(F.col("i") == 0, -0.5)]}
    best = df.select("i", doctypes.best_type(doctypes.type_scores(F.col("t"), F.col("f"), F.col("l"), rules, layout)).alias("b")).select("i", "b.*")
    got = {r["i"]: (r["label"], r["confidence"], r["score"], r["margin"], r["runner_up"]) for r in best.collect()}
    assert got == {
        0: ("A", 0.9, 5.5, 5.5, None), 1: ("B", 0.9, 4.0, 4.0, None), 2: ("B", 0.5, 1.0, 1.0, None), 3: ("C", 0.55, 2.0, 1.0, "B"),
        4: ("B", 0.5, 1.0, 0.0, "C"), 5: ("UNKNOWN", 0.2, 0.0, 0.0, None),
    }
    with pytest.raises(ValueError):
        doctypes.type_scores(F.col("t"), F.col("f"), F.col("l"), {"A": {"maybe": ("x",)}})
