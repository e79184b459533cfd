"""Spans, sections and the rules over them."""

import random

from pyspark.sql import functions as F

from ratelake.operators import documents, statuses


def spans_by_hand(pages):
    out = []
    for page, kind, leaves, titles in pages:
        now = out[-1] if out else None
        starts = (
            now is None
            or bool(leaves and titles)
            or (bool(leaves) and not leaves & now[3])
            or (not leaves and bool(titles) and now[2] == "tariff" and not titles & now[4])
            or (not leaves and not titles and kind == "tariff" and now[2] == "procedural")
        )
        if starts:
            out.append([page, page, kind, set(leaves), set(titles)])
        else:
            now[1] = page
            now[3] |= leaves
            now[4] |= titles
            if kind == "tariff" and now[2] == "procedural":
                now[2] = "tariff"
    return [(a, b, k, sorted(x), sorted(y)) for a, b, k, x, y in out]


def test_spans_equal_a_plain_loop(spark):
    rng = random.Random(3)
    some = lambda names: {n for n in names if rng.random() < 0.3}
    docs = {d: [(p, rng.choice(["tariff", "procedural", "unknown"]), some("12"), some("ab")) for p in range(1, rng.randint(2, 20))] for d in range(30)}
    rows = [(d, p, k, sorted(x), sorted(y)) for d, pages in docs.items() for p, k, x, y in pages]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc int, page bigint, doc_type string, leaves array<string>, titles array<string>").repartition(5)
    got = {}
    for r in documents.segment_pages(table, "doc").orderBy("doc", "span").collect():
        got.setdefault(r["doc"], []).append((r["start_page"], r["end_page"], r["doc_type"], r["leaves"], r["titles"]))
    assert got == {d: spans_by_hand(pages) for d, pages in docs.items()}
    assert documents.segment_pages(table.where("false"), "doc").count() == 0


def test_touching_spans_of_one_kind_merge(spark):
    spans = spark.createDataFrame([(1, "a", 1, 2), (1, "a", 3, 3), (1, "b", 4, 4), (1, "a", 5, 5), (1, "a", 8, 9)], "d int, kind string, start_page int, end_page int")
    got = sorted((r["start_page"], r["end_page"], r["spans"]) for r in documents.merge_neighbours(spans, "d", "kind").collect())
    assert got == [(1, 3, 2), (4, 4, 1), (5, 5, 1), (8, 9, 1)]


def test_tiers_and_bindings(spark):
    rows = spark.createDataFrame([(0.9, "p", 0.2, True, "p"), (0.9, "p", 0.1, True, None), (0.9, None, 0.9, None, "q"), (0.4, "p", 0.9, False, "q"), (None, "p", None, None, "")], "c double, top string, m double, safe boolean, cur string")
    status, agrees = documents.binding(F.col("top"), F.col("safe"), F.col("cur"))
    got = [tuple(r) for r in rows.select(documents.routing_tier(F.col("c"), F.col("top"), F.col("m")), status, agrees).collect()]
    assert got == [(1, "proposed", True), (2, "proposed", None), (3, "no_consensus", None), (3, "refused_unsafe", False), (3, "refused_unsafe", None)]


def test_stale_stages_of_documents_without_a_start(spark):
    kind = "page_version string, ocr_version string, normalization_version string, span_version string, parser_version string, scanned boolean, dated boolean"
    rows = spark.createDataFrame([(None, None, None, None, None, True, False), (None, None, None, "s1", "h1", True, True), ("p1", "o0", "n1", "s1", "h1", True, False), ("p1", None, None, "s1", "h1", False, True)], kind)
    wanted = {"page": "p1", "ocr": "o1", "normalization": "n1", "span": "s1", "parser": "h1"}
    reasons, priority = statuses.staleness(wanted, F.col("scanned"), F.col("dated"))
    assert [tuple(r) for r in rows.select(reasons, priority).collect()] == [([], None), (["page_artifact_missing"], 85), (["ocr_backend_version"], 95), ([], None)]
