"""Coverage, nearest values, sections and evidence against plain loops."""

import bisect
import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from ratelake.operators import coverage, evidence, nearest, sections
from ratelake.plans import timeline_queries

DAY = datetime.date(2020, 1, 1)


def day(n):
    return None if n is None else DAY + datetime.timedelta(days=n)


def plain_stretches(versions):
    """(kind, first day, last day or None) of each stretch by looking at every day."""
    good = [(a, z) for a, z in versions if a is not None and (z is None or z >= a)]
    if not good:
        return []
    last = max(z if z is not None else a for a, z in good) + 2
    kinds = []
    for d in range(min(a for a, _ in good), last + 1):
        n = sum(a <= d and (z is None or d <= z) for a, z in good)
        kinds.append((d, "gap" if n == 0 else "single" if n == 1 else "overlap"))
    out = []
    for d, kind in kinds:
        if out and out[-1][0] == kind:
            out[-1][2] = d
        else:
            out.append([kind, d, d])
    if out[-1][0] == "gap":
        out.pop()
    else:
        out[-1][2] = None if any(z is None for _, z in good) else out[-1][2]
    return [tuple(x) for x in out]


def test_stretches_equal_looking_at_every_day(spark):
    rng = random.Random(1)
    tables = {k: [(rng.choice([None, *range(40)]), None if rng.random() < 0.1 else rng.randint(-2, 60)) for _ in range(rng.randint(1, 7))] for k in range(60)}
    tables[None] = [(0, 3), (0, 3), (10, None)]
    rows = [(k, i, day(a), day(z)) for k, own in tables.items() for i, (a, z) in enumerate(own)]
    df = spark.createDataFrame(rows, "k bigint, id int, a date, z date")
    got = {k: [] for k in tables}
    for r in coverage.stretches(df, ["k"], "a", "z", "id").orderBy("k", "starts").collect():
        got[r["k"]].append((r["kind"], (r["starts"] - DAY).days, None if r["ends"] is None else (r["ends"] - DAY).days))
        assert r["days"] == (None if r["ends"] is None else (r["ends"] - r["starts"]).days + 1)
        assert r["kind"] != "gap" or (tables[r["k"]][r["before"]][1] + 1, tables[r["k"]][r["after"]][0]) == (got[r["k"]][-1][1], got[r["k"]][-1][2] + 1)
    assert got == {k: plain_stretches(own) for k, own in tables.items()}
    odd = {(r["k"], r["id"]): r["kind"] for r in coverage.flaws(df, ["k"], "a", "z", "id").collect()}
    assert odd == {(k, i): "undated_version" if a is None else "inverted_version" for k, own in tables.items() for i, (a, z) in enumerate(own) if a is None or z is not None and z < a}
    status = {r["k"]: r["status"] for r in coverage.timeline_status(df, ["k"], "a", "z", "id").collect()}
    assert set(status) == set(tables) and status[None] == "gaps_exist"
    assert coverage.stretches(df.limit(0), ["k"], "a", "z", "id").count() == 0


def test_nearest_values_equal_full_comparison(spark):
    rng = random.Random(2)
    values = {k: sorted({rng.choice([rng.randint(-50, 50), rng.randint(-(10**12), 10**12)]) for _ in range(n)}) for k, n in (("a", 40), ("b", 1), ("c", 7))}
    targets = [(k, t) for k in "abcd" for t in (rng.choice([rng.randint(-60, 60), rng.randint(-(10**12), 10**12)]) for _ in range(50))] + [("a", None), (None, 3)]
    v = spark.createDataFrame([(k, x) for k, own in values.items() for x in own] * 2, "k string, v bigint")
    t = spark.createDataFrame(targets, "k string, t bigint")
    got = {(r["k"], r["t"]): (r["below"], r["above"]) for r in nearest.bracket(t, v, ["k"], "t", "v").collect()}
    want = {(k, t): (max((x for x in values[k] if x <= t), default=None), min((x for x in values[k] if x > t), default=None)) for k, t in targets if t is not None and k in values}
    assert got == want


def test_nearest_values_take_one_pass_and_hot_places_are_spread(spark, monkeypatch):
    written = []
    monkeypatch.setattr(nearest, "staged", lambda df, label, real=nearest.staged: written.append(real(df, label)) or written[-1])
    v = spark.range(0, 1000).selectExpr("'a' AS k", "id * id * 1000003 AS v").unionByName(spark.createDataFrame([("b", 5)], "k string, v bigint"))
    rows = spark.range(0, 4000).selectExpr("id", "IF(id % 2 = 0, 'a', 'b') AS k", "IF(id < 3000, 7, id * 100000) AS t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = nearest.between(rows, v, ["k"], "t", "v", "x", "y").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r["id"]: (r["x"] and r["x"]["v"], r["y"] and r["y"]["v"]) for r in found}
    values = {"a": [i * i * 1000003 for i in range(1000)], "b": [5]}
    for i in range(4000):
        own, at = values["ab"[i % 2]], 7 if i < 3000 else i * 100000
        n = bisect.bisect_right(own, at)
        assert got[i] == (own[n - 1] if n else None, own[n] if n < len(own) else None)
    assert len(written) == 1 and written[0].where("__side = 1 AND __at = 7 AND k = 'a'").select("__part").distinct().count() > 1


def test_best_snapshot_cases(spark):
    since = [day(i) for i in range(6)]
    snaps = [("x", "cents_per_kwh", 2.0, since[3]), ("x", "cents_per_kwh", 2.0, since[1]), ("x", "cents_per_kwh", 4.0, since[0]), ("x", "fixed_monthly", 31.0, since[2]), ("x", "other", 30.0, since[0]), ("x", "fixed_monthly", None, since[0]), ("y", "cents_per_kwh", 1.0, None)]
    bills = [(1, "x", 20.0, 1000.0), (2, "x", 30.0, 1000.0), (3, "x", 30.0, None), (4, "x", None, 10.0), (5, "y", 1.0, 100.0), (6, "x", 30.6, 0.0), (1, "x", 20.0, 1000.0)]
    b = spark.createDataFrame(bills, "id int, c string, amount double, kwh double")
    s = spark.createDataFrame(snaps, "c string, unit string, value double, since date")
    got = sorted((r["id"], r["unit"], r["value"], r["since"], r["estimate"]) for r in nearest.best_snapshot(b, s, ["id"], "c", "amount", "kwh", "unit", "value", "since").collect())
    assert got == [
        (1, "cents_per_kwh", 2.0, since[1], 20.0), (1, "cents_per_kwh", 2.0, since[1], 20.0), (2, "fixed_monthly", 31.0, since[2], 31.0),
        (3, "fixed_monthly", 31.0, since[2], 31.0), (6, "fixed_monthly", 31.0, since[2], 31.0),
    ]


def plain_sections(pages):
    """Sections of one document by plain loops; pages are dicts in order."""
    spans = []
    for p in pages:
        if spans and spans[-1][-1]["kind"] == p["kind"] and spans[-1][-1]["page"] + 1 == p["page"]:
            spans[-1].append(p)
        else:
            spans.append([p])
    parts = []
    for number, span in enumerate(spans):
        leaves, codes, cuts = set(), set(), [0]
        for i, p in enumerate(span):
            pl, pc = set(p["leaves"]), set(p["codes"])
            nl, nc = (set(span[i + 1][c]) for c in ("leaves", "codes")) if i + 1 < len(span) else (set(), set())
            cut = False
            if pl and leaves and not pl & leaves and pl & nl:
                cut, leaves, codes = True, pl, set()
            if pc and codes and not pc & codes and pc & nc:
                cut, leaves, codes = True, set(), pc
            if p["heading"] and pc and codes and not pc & codes and i >= 2:
                cut, leaves, codes = True, set(), pc
            if not codes and pc:
                codes = pc
            if len(span) > 8 and i >= 2 and pc - codes and pc & nc:
                cut, leaves, codes = True, set(), pc
            if not leaves and pl:
                leaves = pl
            if i >= 2:
                q = span[i - 1]
                cut = cut or (p["effective"] and not q["effective"] and not q["header"]) or (p["redline"] and not q["redline"])
            if cut and i:
                cuts.append(i)
        parts += [(number, span[a:b]) for a, b in zip(cuts, [*cuts[1:], len(span)], strict=True)]
    merged = []
    for number, part in parts:
        leaves, codes = {x for p in part for x in p["leaves"]}, {x for p in part for x in p["codes"]}
        new = {"span": number, "pages": part, "leaves": leaves, "codes": codes, "end": part[-1]["page"]}
        old = merged[-1] if merged else None
        if old and old["end"] + 1 >= part[0]["page"]:
            shared = old["leaves"] & leaves, old["codes"] & codes
            same = old["span"] == number
            if same and any(shared) or not same and old["pages"][0]["kind"] == part[0]["kind"] and shared[1]:
                old["pages"], old["end"] = old["pages"] + part, new["end"]
                old["leaves"] |= leaves if shared[0] else set()
                old["codes"] |= codes if shared[1] else set()
                continue
        merged.append(new)
    out = []
    for s in merged:
        n = len(s["pages"])
        leaf, heading, values, toc = (sum(p[f] for p in s["pages"]) for f in ("header", "heading", "values", "toc"))
        tariff, procedural = (sum(p[f] for p in s["pages"]) / n for f in ("tariff", "procedural"))
        if toc > n * 0.3:
            kind = "table_of_contents"
        elif procedural > 0.05:
            kind = "procedural"
        elif s["pages"][0]["page"] <= 2 and not values and not leaf and tariff < 0.01:
            kind = "cover_letter"
        elif heading and values:
            kind = "rate_schedule"
        elif leaf and heading:
            kind = "terms_conditions"
        elif leaf and values:
            kind = "rider"
        elif not leaf and not heading:
            kind = "terms_conditions" if values else "cover_letter"
        else:
            kind = "unknown"
        bare = kind in ("cover_letter", "table_of_contents")
        leaves, codes = ([] if bare else sorted(s[c]) for c in ("leaves", "codes"))
        points = 0.3 * bool(leaves) + 0.2 * bool(codes) + 0.15 * (kind != "unknown") + 0.2 * ((kind in ("rate_schedule", "rider")) == (s["pages"][0]["kind"] == "tariff")) + 0.15 * (values >= 2)
        out.append((s["pages"][0]["page"], s["end"], n, s["pages"][0]["kind"], kind, leaves, codes, round(min(1, points), 3)))
    return out


PAGES = "doc bigint, page int, kind string, leaves array<string>, codes array<string>, header boolean, heading boolean, effective boolean, redline boolean, toc boolean, `values` boolean, tariff double, procedural double"


def page(rng, number):
    some = lambda pool, p: sorted(rng.sample(pool, rng.randint(1, 2))) if rng.random() < p else []
    flag = lambda p: rng.random() < p
    return {
        "page": number, "kind": rng.choice(["tariff"] * 6 + ["procedural"]), "leaves": some(list("12345"), 0.6), "codes": some(list("ABCD"), 0.6), "header": flag(0.4), "heading": flag(0.3),
        "effective": flag(0.15), "redline": flag(0.1), "toc": flag(0.1), "values": flag(0.4), "tariff": rng.random() / 50, "procedural": rng.random() / 15,
    }


def sections_of(df):
    out = {}
    for r in sections.build_sections(df, "doc").orderBy("doc", "section").collect():
        out.setdefault(r["doc"], []).append((r["start_page"], r["end_page"], r["pages"], r["kind"], r["section_type"], r["leaves"], r["codes"], r["confidence"]))
    return out


def test_sections_equal_plain_loops(spark):
    rng = random.Random(3)
    docs = {d: [page(rng, n) for n in range(rng.randint(1, 40)) if rng.random() < 0.97] for d in range(60)}
    rows = [(d, *p.values()) for d, own in docs.items() for p in own]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, PAGES)
    assert sections_of(df) == {d: plain_sections(own) for d, own in docs.items() if own}
    plan = sections.build_sections(df, "doc")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sections_of_whole_texts(spark):
    d = "/root/testdata/sf0.001"
    signals = timeline_queries.page_signals(spark.read.parquet(f"{d}/documents.parquet"))
    docs = {}
    for r in signals.orderBy("doc_id", "page").collect():
        docs.setdefault(r["doc_id"], []).append(r.asDict())
    got = {}
    for r in timeline_queries.section_pipeline(spark, d).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append((r["start_page"], r["end_page"], r["pages"], r["kind"], r["section_type"], r["leaves"], r["codes"], r["confidence"]))
    want = {i: [(*s[:5], ",".join(s[5]), ",".join(s[6]), s[7]) for s in plain_sections(own)] for i, own in docs.items()}
    assert got == want and max(map(len, got.values())) > 5


def test_sections_with_nulls(spark):
    rows = [(1, 0, None, None, None, *[None] * 8), (1, None, "tariff", ["1"], [], *[True] * 6, 0.0, 0.0), (1, 0, "tariff", ["1", None, "1"], ["A"], *[True] * 6, 0.0, 0.0)]
    found = sections_of(spark.createDataFrame(rows, PAGES))
    assert found == {1: [(0, 0, 1, "unknown", "cover_letter", [], [], 0.15 + 0.2)]}
    assert sections.build_sections(spark.createDataFrame([], PAGES), "doc").count() == 0


def test_votes_by_hand(spark):
    votes = [
        ("d", "rules", "A", 0.9, 1), ("d", "rules", "B", 0.5, 2), ("d", "model", "A", 0.8, 1), ("d", "names", "B", 1.5, 1), ("d", "other", "C", None, 1),
        ("e", "rules", "A", 1.0, 1), ("e", "rules", None, 1.0, 2), ("f", "model", "Z", 0.5, 1), ("f", "names", "Y", 1.0, 1), (None, "model", "Q", 1.0, 1),
    ]
    df = spark.createDataFrame(votes, "doc string, source string, label string, confidence double, at int")
    got = {r["doc"]: r for r in evidence.fuse_votes(df, ["doc"], "source", "label", "confidence", [F.desc("at")], {"rules": 2.0, "model": 1.0, "names": 0.5}).collect()}
    assert got["d"].asDict() | {"consensus": 0, "margin": 0} == {"doc": "d", "first": "B", "first_score": 1.5, "second": "A", "second_score": 0.8, "consensus": 0, "margin": 0, "voters": 3, "votes": 5}
    assert got["d"]["consensus"] == pytest.approx(1.5 / 2.3) and got["d"]["margin"] == pytest.approx(0.7 / 2.3)
    assert got["e"]["first"] is None and got["e"]["consensus"] == 0 and got["e"]["votes"] == 2
    assert (got["f"]["first"], got["f"]["second"], got["f"]["margin"]) == ("Y", "Z", 0)
    assert got[None]["first"] == "Q" and got[None]["second"] is None and got[None]["margin"] == 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_few_quotes_explode_no_runs(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(evidence, "_grams", lambda text, real=evidence._grams: calls.append(1) or real(text))
    lines = evidence.text_lines(spark.createDataFrame([(1, "the first line\nthe second lines\nthe second line")], "doc bigint, text string"), "doc", "text")
    quotes = [(1, i, "the second lime") for i in range(evidence.FEW_QUOTES + 1)]
    find = lambda n: evidence.locate_lines(spark.createDataFrame(quotes[:n], "doc bigint, q int, quote string"), lines, "doc", "q", "quote")
    few = sorted(tuple(r) for r in find(len(quotes) - 1).collect())
    assert few == [(1, i, 2, 32, 15, 1) for i in range(len(quotes) - 1)] and not calls
    assert sorted(tuple(r) for r in find(len(quotes)).collect()) == [*few, (1, len(quotes) - 1, 2, 32, 15, 1)] and calls


@pytest.mark.parametrize("few", [0, 100])
def test_lines_equal_brute_force_by_either_way(spark, monkeypatch, few):
    monkeypatch.setattr(evidence, "FEW_QUOTES", few)
    test_lines_equal_brute_force_over_all(spark)


def test_lines_equal_brute_force_over_all(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    docs, quotes = [], []
    for d in range(25):
        lines = [" ".join(word() for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 12))]
        lines += [rng.choice(lines).upper() + rng.choice(["", "  ", " x"])]
        docs.append((d, "\n".join(lines)))
        for q in range(8):
            text = list(rng.choice(lines)) + list(rng.choice(["", "zz"]))
            for _ in range(rng.randint(0, 4)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(["", "q", "ab"])
            quotes.append((d, q, "".join(text)))
    quotes += [(0, 90, None), (0, 91, " "), (99, 0, "abc")]
    docs += [(97, None), (98, "")]
    df = spark.createDataFrame(docs, "doc bigint, text string")
    lines = evidence.text_lines(df, "doc", "text").cache()
    got = {(r["doc"], r["q"]): (r["line"], r["start"], r["size"], r["distance"]) for r in evidence.locate_lines(spark.createDataFrame(quotes, "doc bigint, q int, quote string"), lines, "doc", "q", "quote").collect()}
    plain = lambda t: " ".join((t or "").lower().split())
    want = {}
    texts = dict(docs)
    for d, q, quote in quotes:
        wanted, at, found = plain(quote), 0, []
        for n, line in enumerate((texts.get(d) or "").split("\n")):
            if wanted and plain(line):
                e = edits(plain(line), wanted)
                found += [(e, n, at, len(line))] if e <= int(len(wanted) * 0.15) else []
            at += len(line) + 1
        if found:
            e, n, at, size = min(found)
            want[d, q] = (n, at, size, e)
    assert got == want and len(want) > 80 and any(v[3] for v in want.values())


def test_spans_are_not_counted_again_for_each_page(spark):
    n = 2000
    none = F.array().cast("array<string>")
    pages = spark.range(n).select(
        F.lit(1).alias("doc"), F.col("id").alias("page"), F.concat(F.lit("k"), (F.col("id") % 2).cast("string")).alias("kind"), none.alias("leaves"), none.alias("codes"),
        *(F.lit(False).alias(f) for f in ("header", "heading", "effective", "redline", "toc", "values")), F.lit(0.0).alias("tariff"), F.lit(0.0).alias("procedural"),
    )
    began = time.time()
    found = sections.build_sections(pages, "doc").agg(F.count("*").alias("n"), F.sum("pages").alias("pages"), F.max("end_page").alias("last")).first()
    assert tuple(found) == (n, n, n - 1) and time.time() - began < 45
