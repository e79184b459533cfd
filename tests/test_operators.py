"""Set operators, calendar and rate functions on small hand-made cases and against plain loops."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ratelake.functions import calendar, rates
from ratelake.operators import asof, compare, graph, latest, retrieval, sequences
from ratelake.plans import intervals
from ratelake.streaming import usage as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_holidays(spark):
    got = sorted(one(spark, calendar.holidays_of(F.lit(2024))))
    assert got == [date(2024, 1, 1), date(2024, 5, 27), date(2024, 7, 4), date(2024, 9, 2), date(2024, 11, 28), date(2024, 12, 25)]
    assert date(2020, 7, 3) in one(spark, calendar.holidays_of(F.lit(2020)))


@pytest.mark.parametrize(
    ("label", "month", "want"),
    [("May - September", 5, True), ("may–september", 10, False), ("summer", 5, False), ("winter", 12, True), (None, 3, True), ("", 3, True), ("harvest", 3, True), ("July-October", 0, True)],
)
def test_seasons(spark, label, month, want):
    assert one(spark, calendar.season_matches(F.lit(label).cast("string"), F.lit(month))) is want


@pytest.mark.parametrize(
    ("when", "want"),
    [("2025-11-03 15:00:00", "on_peak"), ("2025-11-03 21:00:00", "discount"), ("2025-11-03 05:59:00", "discount"), ("2025-11-03 06:00:00", "off_peak"), ("2025-11-08 22:00:00", "off_peak"), ("2024-07-04 15:00:00", "off_peak")],
)
def test_periods(spark, when, want):
    assert one(spark, calendar.tou_period(F.lit(when).cast("timestamp"))) == want


def test_rates(spark):
    assert one(spark, rates.in_dollars(F.lit(12.5), F.lit("Cents/kWh"))) == 0.125
    assert one(spark, rates.in_dollars(F.lit(12.5), F.lit(None).cast("string"))) == 12.5
    assert one(spark, rates.label_class(F.lit("Medium General Service TOU"))) == "commercial_medium"
    assert one(spark, rates.class_matches(F.lit("secondary"), F.lit("residential"))) is True
    assert one(spark, rates.class_matches(F.lit("industrial"), F.lit("residential"))) is False
    assert one(spark, rates.period_start(F.lit("2024-Q3"))) == date(2024, 7, 1)
    assert one(spark, rates.period_start(F.lit("2024-13"))) is None


@pytest.mark.parametrize(
    ("tiers", "kwh", "want"),
    [([(0, None)], 1000, [1000]), ([(0, 800), (800, None)], 500, [500, 0]), ([(0, 800), (800, None)], 1200, [800, 400]), ([(0, 800), (800, None)], 800, [800, 0]), ([(0, 800), (800, None)], 0, [0, 0])],
)
def test_tiers(spark, tiers, kwh, want):
    rows = spark.createDataFrame([(1, float(kwh), float(a), None if b is None else float(b)) for a, b in tiers], "k int, q double, lo double, hi double")
    got = sequences.allocate_tiers(rows, ["k"], "q", "lo", "hi").orderBy("lo")
    assert [r["tier_quantity"] for r in got.collect()] == want


def test_random_ladders_equal_the_loop(spark):
    rng, rows, want = random.Random(4), [], {}
    for k in range(300):
        ladder = sorted({(float(rng.randrange(0, 900, 50)), float(rng.randrange(50, 1200, 50)) if rng.random() < 0.7 else None) for _ in range(rng.randint(1, 4))}, key=lambda t: (t[0], t[1] or 1e9))
        kwh = left = float(rng.randrange(0, 1500, 25))
        for lo, hi in ladder:
            take = min(max((kwh if hi is None else hi) - lo, 0.0), left)
            left -= take
            want[k, lo, hi] = take
            rows.append((k, kwh, lo, hi))
    got = sequences.allocate_tiers(spark.createDataFrame(rows, "k int, q double, lo double, hi double"), ["k"], "q", "lo", "hi").collect()
    assert {(r["k"], r["lo"], r["hi"]): r["tier_quantity"] for r in got} == want


def test_tiers_with_offset(spark):
    rows = spark.createDataFrame([(1, 300.0, 600.0, 0.0, 800.0), (1, 300.0, 600.0, 800.0, None)], "k int, q double, start double, lo double, hi double")
    got = sequences.allocate_tiers(rows, ["k"], "q", "lo", "hi", offset="start").orderBy("lo")
    assert [r["tier_quantity"] for r in got.collect()] == [200.0, 100.0]


def test_asof_ties_nulls_and_inner(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (None, 9), (1, None)], "k int, at int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 5, "c"), (1, None, "z"), (None, 1, "n")], "k int, since int, v string")
    got = {(r["k"], r["at"]): r["v"] for r in asof.asof_join(left, right, ["k"], "at", "since", ["v"]).collect()}
    assert got == {(1, 5): "c", (1, 1): None, (2, 9): None, (None, 9): None, (1, None): None}
    assert asof.asof_join(left, right, ["k"], "at", "since", ["v"], inner=True).count() == 1


def test_select_version_fallbacks(spark):
    asked = spark.createDataFrame([("a", date(2020, 1, 1)), ("a", date(2000, 1, 1)), ("b", date(2020, 1, 1)), ("c", date(2020, 1, 1))], "f string, at date")
    versions = spark.createDataFrame([("a", 1, date(2010, 1, 1), "approved"), ("a", 2, date(2019, 1, 1), "approved"), ("a", 3, date(2019, 6, 1), "proposed"), ("b", 4, None, "proposed")], "f string, v int, start date, status string")
    got = {(r["f"], r["at"].year): r["v"] for r in asof.select_version(asked, versions, ["f"], "at", "start", ["v"], F.col("status") == "approved").collect()}
    assert got == {("a", 2020): 2, ("a", 2000): 1, ("b", 2020): 4}


def test_islands_and_gaps(spark):
    rows = spark.createDataFrame([(1, date(2024, 1, d), v) for d, v in ((1, "x"), (2, "x"), (3, "y"), (20, "y"))], "k int, day date, v string")
    new = (sequences.previous("v") != F.col("v")) | (F.datediff("day", sequences.previous("day")) > 10)
    assert [r["island"] for r in sequences.islands(rows, ["k"], ["day"], new).orderBy("day").collect()] == [1, 1, 2, 3]
    assert [r["gap_days"] for r in sequences.gaps(rows, ["k"], "day", 10).collect()] == [17]
    numbers = spark.createDataFrame([(1, 2), (1, 5), (1, 5), (2, 1)], "k int, n int")
    assert sorted(r["missing"] for r in sequences.missing_numbers(numbers, ["k"], "n").collect()) == [3, 4]


def test_chains_with_a_cycle(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (10, 11), (11, 10), (12, 11), (20, 99)], "node bigint, parent bigint")
    got = {r["node"]: (r["root"], r["depth"]) for r in graph.chains(nodes).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 10: (None, None), 11: (None, None), 12: (None, None), 20: (99, 1)}


def test_reconcile_and_findings(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 5.0)], "k string, v double")
    e = spark.createDataFrame([("x", 4.0), ("z", 1.0)], "k string, v double")
    got = {r["k"]: (r["status"], r["delta"]) for r in compare.reconcile(a, e, ["k"], "v").collect()}
    assert got == {"x": ("matched", 1.0), "y": ("actual_only", -5.0), "z": ("estimated_only", 1.0)}
    found = compare.findings(a, {"big": F.col("v") > 1, "odd": F.col("k") == "y"}, "k")
    assert sorted((r["k"], r["finding"]) for r in found.collect()) == [("x", "big"), ("y", "big"), ("y", "odd")]


def test_upsert_and_missing(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b"), (None, 1, "n")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 1, "A"), (2, 4, "B"), (3, 0, "C")], "k int, v int, x string")
    assert {r["k"]: r["x"] for r in latest.keep_latest(old, new, ["k"], "v").collect()} == {1: "A", 2: "b", 3: "C", None: "n"}
    assert [r["k"] for r in latest.missing_from(new, old, ["k"]).collect()] == [3]
    assert latest.missing_from(old, old, ["k"]).count() == 0


def test_retrieval(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0], "p"), (2, [0.0, 1.0, 0.0], "q"), (3, [0.9, 0.1, 0.0], None), (4, [0.0, 0.0, 1.0], "p"), (5, [0.0, 0.0, 0.0], "p")], "id int, v array<double>, label string")
    queries = spark.createDataFrame([("s", [1.0, 0.0, 0.0])], "query_id string, q array<double>")
    hits = retrieval.search(queries, vectors, 4)
    assert [r["id"] for r in hits.orderBy("rank").collect()] == [1, 3, 2, 4]
    assert [(r["label"], r["place"]) for r in retrieval.votes(hits).orderBy("place").collect()] == [("p", 1), ("q", 2)]
    assert retrieval.votes(hits, 4).count() == 0
    m = retrieval.measures(hits, spark.createDataFrame([("s", "q"), ("t", "q")], "query_id string, label string")).first()
    assert (m["recall_at_5"], m["mrr_at_10"]) == (0.5, round(1 / 6, 6))


def test_monthly_summary(spark):
    points = spark.createDataFrame([("m", datetime(2025, 11, 3, 20, 0), 2.0), ("m", datetime(2025, 11, 4, 3, 0), 1.0), ("m", datetime(2025, 12, 2, 3, 0), 1.0), ("m", datetime(2026, 1, 9, 3, 0), 1.0)], "meter_id string, timestamp timestamp, kwh double")
    got = {r["month"]: r for r in intervals.monthly_summary(points).collect()}
    assert (got[11]["on_peak_kwh"], got[11]["discount_kwh"], got[11]["peak_kw"]) == (2.0, 1.0, 8.0)
    assert [got[m]["gap_warning"] for m in (11, 12, 1)] == [False, True, False]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 7, datetime(2024, 1, 1 + i % 3, i % 24), i % 2, float(i)) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, value double").dropDuplicates(["event_id"])
    end = spark.createDataFrame([(99, datetime(2024, 2, 1), 9, 0.0)], events.schema)
    for i, part in enumerate((events, end, end.withColumn("event_id", F.lit(100).cast("bigint")))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            query = streams.period_usage(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("periods").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
    query.stop()
    key = lambda r: (r["user_id"], r["start"], r["period"], r["kwh"], r["n"])
    assert sorted(map(key, spark.table("periods").where("user_id <> 9").collect())) == sorted(map(key, streams.period_usage(events).collect()))
    assert streams.sessions(events, "2 hours").agg(F.sum("n")).first()[0] == events.count()


def test_histories_carried_together_equal_asof_joins(spark):
    a = spark.createDataFrame([(1, 3, 1, 5.0), (1, 3, 2, None), (1, 9, 3, 7.0), (None, 2, 4, 1.0), (1, None, 5, 2.0)], "k int, a_at int, a_id int, a double")
    b = spark.createDataFrame([(1, 1, 8), (1, 4, 9), (2, 5, 6), (None, 3, 4)], "k int, b_at int, b int")
    spine = a.select("k", "a_at").union(b.select("k", "b_at")).distinct().withColumnRenamed("a_at", "at")
    want = asof.asof_join(asof.asof_join(spine, a, ["k"], "at", "a_at", ["a_id"]), b, ["k"], "at", "b_at")
    got = asof.carried_together([(a, "a_at", ["a_id"]), (b, "b_at", [])], ["k"], "at")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
