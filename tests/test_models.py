"""Patterns, splits, neighbours, upserts and stale claims against plain loops and by hand."""

import datetime
import glob
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelake.operators import knn, patterns, splits
from ratelake.sources.upsert import Upserted, upsert
from ratelake.streaming.recovery import stale_claims_batch, stale_claims_stream


@pytest.mark.parametrize(
    "pattern, literal",
    [(r"(?i)Foo\d+barbaz", "barbaz"), (r"(?:cat|dog)house", "house"), (r"x(?:abc)+y", "xabc"), (r"a?bcd*", "bc"), (r"[ab]c", "c"), (r"(ab){0,3}", ""), (r"(", None), (r"^abc$", "abc"), (r"(?=abc)d", "d"), (r"é abc", "abc"), (r"", "")],
)
def test_required_literals(pattern, literal):
    assert patterns.required_literal(pattern) == literal


def test_patterns_equal_trying_every_one(spark):
    rng = random.Random(4)
    words = ["Alpha", "beta9", "gamma", "ALPHABET", "delta-x", "é", "bet", "a", "gam ma", "\n"]
    docs = [(i, rng.choice(["en", "de"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(80)] + [(80, "en", None), (81, "de", "")]
    listed = [("alpha", r"(?i)\balpha\b"), ("beta", r"beta\d"), ("rep", r"(?:gamma ?)+"), ("either", r"alpha|beta"), ("tail", r"\w+phabet"), ("Case", r"Alpha"), ("bad", "[")]
    df = spark.createDataFrame(docs, "id bigint, lang string, text string")
    got = {(r["id"], r["name"]): r["matches"] for r in patterns.matches(df, listed, "id", "text").collect()}
    usable = [(n, p) for n, p in listed if len(patterns.required_literal(p) or "") >= 3]
    want = {(i, n): len(re.findall(p, t or "")) for i, _, t in docs for n, p in usable}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert len(got) < len(want)  # fewer texts are tried than there are pairs
    cases = spark.createDataFrame([("alpha", "ALPHA!", True), ("alpha", "alphabet", False), ("alpha", None, True), ("bad", "x", True)], "name string, text string, positive boolean")
    found = {r["name"]: r for r in patterns.validate(df, listed, cases, F.col("lang") == "en", "id", "text").collect()}
    assert found["bad"]["status"] == "rejected_invalid_regex" and found["either"]["status"] == "rejected_no_anchor" and found["either"]["candidates"] == 0
    for name, p in usable:
        hits = [lang for _, lang, t in docs if re.search(p, t or "")]
        assert (found[name]["own_matched"], found[name]["false_positives"]) == (hits.count("en"), hits.count("de"))
    assert (found["alpha"]["positive_rate"], found["alpha"]["negative_rate"]) == (0.5, 1.0)


@pytest.mark.parametrize("digits", [4, 1])
def test_shares_are_exact_and_repeat(spark, monkeypatch, digits):
    monkeypatch.setattr(splits, "DIGITS", digits)
    sizes = {"big": 997, "mid": 40, "tiny": 4, None: 9}
    rows = [(f"{label}{i}" if i % 7 else "same", label, "other") for label, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id string, label string, part string")
    split = splits.stratified_split(df, "label", "id", 0.25)
    held = Counter(r["label"] for r in split.where("held_out").collect())
    assert held == {"big": 249, "mid": 10, None: 2} and split.count() == len(rows)
    cut = splits.folds(df, "label", "id", 5)
    sizes_of = Counter((r["label"], r["fold"]) for r in cut.collect())
    for label, n in sizes.items():
        own = [sizes_of[label, f] for f in range(5)]
        assert sizes_of["tiny", None] == 4 if label == "tiny" else sum(own) == n and max(own) - min(own) <= 1
    again = splits.folds(df.repartition(7), "label", "id", 5)
    assert sorted(map(repr, again.distinct().collect())) == sorted(map(repr, cut.distinct().collect()))
    assert splits.folds(df.limit(0), "label", "id").count() == 0


@pytest.mark.parametrize("block", [4096, 16])
def test_neighbours_equal_full_comparison(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "QUERY_BLOCK", block)
    monkeypatch.setattr(knn, "ROW_BLOCK", block)
    rng = np.random.default_rng(5)
    vectors = rng.integers(-3, 4, (150, 4)).astype(float).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(200, None), (201, [0.0] * 4), (202, [float("nan"), 1.0, 0.0, 0.0]), (203, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {}
    for r in knn.nearest(df.where("id % 10 = 0"), df, "id", "v", 5).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], r["score"]))
    x = np.array([v for v in vectors])
    keep = [i for i in range(150) if np.any(x[i])]
    unit = {i: x[i] / np.linalg.norm(x[i]) for i in keep}
    assert set(got) == {i for i in keep if i % 10 == 0}
    for q, found in got.items():
        scores = sorted(((round(float(unit[q] @ unit[i]), 9), i) for i in keep if i != q), key=lambda s: (-s[0], s[1]))[:5]
        assert q not in [i for i, _ in found] and np.allclose([s for _, s in found], [s for s, _ in scores])
        assert all(unit[q] @ unit[i] == pytest.approx(s) for i, s in found)


def test_votes_leave_out_few_and_unlabelled(spark):
    near = spark.createDataFrame([(1, i, 0.5, i) for i in range(1, 7)] + [(2, i, 0.9, i) for i in range(1, 4)] + [(3, i, -1.0, i) for i in range(1, 7)], "query bigint, id bigint, score double, rank int")
    labels = spark.createDataFrame([(1, "a", 1.0), (2, "b", 0.6), (3, "b", 0.6), (4, None, 1.0), (5, "a", None), (6, "b", 0.5)], "id bigint, label string, sure double")
    got = {r["query"]: (r["label"], round(r["share"], 6), r["neighbours"]) for r in knn.vote(near, labels, "id", "label", "sure").collect()}
    assert got == {1: ("b", round(0.85 / 1.6, 6), 5), 2: (None, 0.0, 3), 3: (None, 0.0, 5)}


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_upsert_changes_only_what_it_must(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "state string, year int, price double"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    first = [("A", 2020, 1.0), ("A", 2021, 2.0), ("B", 2020, None), ("C", 2020, 4.0)]
    assert upsert(rows(*first, (None, 2020, 9.0)), path, ["state", "year"], ["price"], "state") == Upserted(4, 0, 0, 1)
    before = files(path)
    again = upsert(rows(*first), path, ["state", "year"], ["price"], "state")
    assert again == Upserted(0, 0, 4, 0) and files(path) == before
    got = upsert(rows(("A", 2021, 5.0), ("A", 2021, 3.0), ("B", 2020, None), ("D", 2020, 1.0)), path, ["state", "year"], ["price"], "state")
    assert got == Upserted(1, 1, 1, 0)
    kept = {f for f in files(path) if f in before}
    assert {re.search("state=(.)", f)[1] for f in kept} == {"B", "C"}
    table = sorted(tuple(r) for r in spark.read.schema(schema).parquet(path).select("state", "year", F.coalesce("price", F.lit(-1.0))).collect())
    assert table == [("A", 2020, 1.0), ("A", 2021, 5.0), ("B", 2020, -1.0), ("C", 2020, 4.0), ("D", 2020, 1.0)]
    assert upsert(rows(*first).limit(0), path, ["state", "year"], ["price"], "state") == Upserted(0, 0, 0, 0)
    with pytest.raises(ValueError):
        upsert(rows(*first), path, ["year"], ["price"], "state")


def plain_stale(events, minutes, most):
    end = max(at for *_, at in events)
    out = []
    for job in {j for j, *_ in events if j}:
        own = sorted((at, kind == "claim") for j, kind, at in events if j == job and kind in ("claim", "done", "failed", "release"))
        tries = 0
        for i, (at, claims) in enumerate(own):
            stale = at + datetime.timedelta(minutes=minutes)
            if claims and (i + 1 == len(own) or own[i + 1][0] > stale) and stale < end:
                tries += 1
                out.append((job, at, stale, tries, "gave_up" if tries >= most else "requeued"))
    return sorted(out)


def test_stream_and_batch_of_stale_claims_agree(spark, tmp_path):
    rng, start = random.Random(6), datetime.datetime(2024, 1, 1)
    events = sorted(((rng.choice("abcdef"), rng.choice(["claim", "claim", "done", "failed", "note"]), start + datetime.timedelta(minutes=m)) for m in rng.sample(range(1500), 90)), key=lambda e: e[2])
    events += [("z", "note", start + datetime.timedelta(days=1, minutes=300)), ("z", "claim", start + datetime.timedelta(days=1, minutes=301))]
    schema = "job string, kind string, at timestamp"
    want = plain_stale(events, 45, 3)
    got = stale_claims_batch(spark.createDataFrame(events, schema), 45).collect()
    assert sorted(tuple(r) for r in got) == want and len(want) > 10
    # Files are read in the order of their times, one in a batch, so that claims go stale between batches and within one.
    for i in range(0, len(events), 15):
        where = str(tmp_path / "in")
        spark.createDataFrame(events[i : i + 15], schema).coalesce(1).write.mode("append").parquet(where)
        new = max(glob.glob(f"{where}/*.parquet"), key=os.path.getctime)
        os.utime(new, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stale_claims_stream(stream, 45).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(240)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_cross_validation_repeats(spark):
    from ratelake.plans.model_queries import cross_validated_model

    first, again = (sorted(map(tuple, cross_validated_model(spark, "/root/testdata/sf0.01").collect())) for _ in range(2))
    assert first == again and [r[0] for r in first] == [0, 1, 2] and max(r[1] for r in first) - min(r[1] for r in first) <= 2
    assert all(r[3] > 0.75 for r in first)


def test_ranks_equal_windows_and_hot_keys_are_split(spark):
    from pyspark.sql.window import Window

    from ratelake.operators.ranks import rank_in

    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randint(0, 5), i, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, id int, n string")
    window = Window.partitionBy("k").orderBy(F.desc("v"), "id")
    want = {r["id"]: r["p"] for r in df.withColumn("p", F.row_number().over(window)).collect()}
    assert {r["id"]: r["place"] for r in rank_in(df, ["k"], [F.desc("v"), F.col("id")]).collect()} == want
    assert rank_in(df.limit(0), ["k"], [F.col("id")]).count() == 0


def test_best_families_of_classes_equal_all(spark):
    from ratelake.operators.documents import family_links

    rng = random.Random(10)
    some = lambda pool, n: sorted(rng.sample(pool, rng.randint(0, n)))
    side = lambda n, name: spark.createDataFrame([(i, some(list("123456"), 2), some(list("AB"), 1), some(["rate", "power", "new", "old"], 3)) for i in range(n)], f"{name} int, leaves array<string>, codes array<string>, words array<string>")
    docs, families = side(120, "d"), side(150, "f")
    every = family_links(docs, families, "d", "f").where("rank <= 3")
    assert sorted(map(tuple, family_links(docs, families, "d", "f", top=3).collect())) == sorted(map(tuple, every.collect()))


def test_neighbours_of_full_blocks_need_little_memory():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from ratelake.operators import knn

    rng = np.random.default_rng(3)
    b = pd.DataFrame({"id": np.arange(knn.ROW_BLOCK), "v": list(rng.normal(size=(knn.ROW_BLOCK, 64)))})
    a = b.iloc[: knn.QUERY_BLOCK]
    tracemalloc.start()
    got = knn.block_best(a, b, 11)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and len(got) == 11 * knn.QUERY_BLOCK and (got["query"] != got["id"]).all()
    unit = np.stack(list(b["v"])) / np.linalg.norm(np.stack(list(b["v"])), axis=1, keepdims=True)
    for q in (0, 63, 64, 2047):
        scores = unit @ unit[q]
        scores[q] = -2
        assert got[got["query"] == q]["id"].tolist() == np.argsort(-scores)[:11].tolist()


def test_folds_count_documents_once_and_only_the_fit_holds_rows_in_memory(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.feature import IDF, IDFModel

    from ratelake.plans import text_model

    rng = random.Random(11)
    words = ["rate", "power", "new", "old", "meter", "tax"]
    rows = [(i, None if i == 7 else " ".join(rng.choice(words[i % 2 * 2 :]) for _ in range(12)) + f" only{i}", None if i == 9 else i % 2) for i in range(90)]
    rows += [(90 + i, "rate rare", 2) for i in range(2)]  # a class too small for three folds: learnt in each, judged in none
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    counted, learnt, fit, regress = [], [], IDF.fit, text_model.LogisticRegression.fit
    monkeypatch.setattr(text_model.IDF, "fit", lambda self, part: (counted.append(part.count()), fit(self, part))[1])
    monkeypatch.setattr(text_model.LogisticRegression, "fit", lambda self, part: (learnt.append((part.count(), part.storageLevel.useMemory)), regress(self, part))[1])
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = text_model.cross_validate(docs).orderBy("fold").collect()
    assert sum(counted) == 91 and sorted(n for n, _ in learnt) == sorted(91 - r["n"] for r in got) and sum(r["n"] for r in got) == 89
    assert not any(memory for _, memory in learnt) and spark.sparkContext._jsc.getPersistentRDDs().size() == held
    assert all(r["accuracy"] > 0.6 for r in got)
    # Sums over parts weigh as one fit over all of them does.
    made = text_model.features(docs.where("label IS NOT NULL"))
    whole: IDFModel = fit(IDF(inputCol="counts", outputCol="w", minDocFreq=text_model.LEAST_DOCUMENTS), made)
    parts = [text_model.documents_with(made.where(f"doc_id % 3 = {i}")) for i in range(3)]
    np.testing.assert_allclose(text_model.rarity(parts), whole.idf.toArray(), rtol=1e-14)
    made.unpersist()
