"""Held-out accuracy of the two classifiers on made-up corpora, and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelake.llm import common, quality, toxicity

SYLLABLES = "an be ra to li en mo su ti ka re do vi no pa".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(spark, make, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(i, *make(rng)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(n, None, "x"), (n + 1, "", "x"), (None, "text", "x"), (0, rows[0][1], "x")], "doc_id bigint, text string, score string").repartition(4)
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(3, None, None), (9999, 1, 1)], "doc_id bigint, quality int, toxic int")
    return rows, docs, labels


def accuracy(rows, out, least=0.5):
    score = {r["doc_id"]: r["score"] for r in out.collect()}
    held = [(score[i] >= least) == (y == 1) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    return float(np.mean(held)), score


def test_fold(spark):
    got = {r["id"]: r["h"] for r in spark.range(200).select("id", common.held_out("id").alias("h")).collect()}
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(200))


def test_quality(spark):
    def make(rng):
        words = prose(rng, rng.randint(20, 200))
        kind = rng.randrange(10)
        bad = {0: lambda: " ".join(w + "***" for w in words.split()), 1: lambda: words.upper().replace(" ", "!! "), 2: lambda: (words.split()[0] + " ") * 50}.get(kind)
        return (bad(), 0) if bad else (words, 1)

    rows, docs, labels = corpus(spark, make)
    model = quality.fit(docs, labels)
    share, score = accuracy(rows, quality.score_quality(docs, model))
    assert share >= 0.95
    assert quality.score_quality(docs, model).count() == docs.count() and 0 <= score[None] <= 1
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema and kept.count() < docs.count()
    assert quality.score_quality(docs.where("false"), model).count() == 0


INSULTS = ["dimwit", "blockhead", "nincompoop"]


def test_toxicity(spark):
    def make(rng):
        words = prose(rng, rng.randint(20, 150)).split()
        y = int(rng.random() < 0.25)
        for _ in range(rng.randint(2, 4) * y):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        return " ".join(words), y

    rows, docs, labels = corpus(spark, make)
    model = toxicity.fit(docs, labels)
    out = toxicity.score_toxicity(docs, model)
    share, score = accuracy(rows, out, toxicity.THRESHOLD)
    assert share >= 0.97 and out.count() == docs.count()
    raw = lambda w: toxicity.worst([w], model)[0, 0]
    plain = max(raw(w) for w in prose(random.Random(8), 300).split())
    for odd in ("dim-wit", "d i m w i t", "dimmwit", "d1mwit", "blockheead", "Nincompoop!!", "x.blockhead"):
        assert raw(odd) > plain, odd
    assert toxicity.score_toxicity(docs.where("false"), model).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_two_classes(spark, module):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id bigint, text string")
    score = quality.score_quality if module is quality else toxicity.score_toxicity
    for labels, want in ((spark.createDataFrame([(i, 1, 1) for i in range(9)], "doc_id bigint, quality int, toxic int"), 1.0), (spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), 0.5)):
        assert {r["score"] for r in score(docs, module.fit(docs, labels)).collect()} == {want}


def test_kernel_tolerates_gaps():
    k = toxicity.kernel(["blockhead", "bloockhead", "blockead", "carpenter"], ["blockhead"])[:, 0]
    assert k[0] == pytest.approx(1, abs=0.15) and k[1] > 0.6 and k[2] > 0.55 and k[3] < 0.25


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rows, docs, labels = corpus(spark, lambda rng: (prose(rng, 30) + (" ***" * 9 if rng.random() < 0.3 else ""), rng.randrange(2)), n=120)
    flipped = labels.withColumn("quality", F.when(common.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.score_quality(docs, quality.fit(docs, x)).where("doc_id IS NOT NULL").orderBy("doc_id").toPandas()["score"] for x in (labels, flipped))
    assert np.allclose(one, two)


def test_foreign_labels_and_a_hot_id_take_no_part(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(2, "copy")] * 5000, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id bigint, quality int")
    got = quality.labelled_sample(docs, labels, "quality", 30).collect()
    ids = [r["doc_id"] for r in got]
    assert len(ids) == len(set(ids)) == 30 and all(0 <= i < 60 and zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)
    every = {r["doc_id"]: r["text"] for r in quality.labelled_sample(docs, labels, "quality", 5000).collect()}
    assert every.get(2, "copy") == "copy" and len(every) <= 60


def test_word_vectors_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, prose(random.Random(i), 50)) for i in range(100)], "doc_id bigint, text string")
    assert np.array_equal(quality.word_vectors(docs.repartition(1)), quality.word_vectors(docs.repartition(7)))


def test_kernel_equals_counting_by_hand():
    def by_hand(a, b):
        def count(word):
            x, out = [toxicity.OPEN, *(ord(c) - 96 for c in word), toxicity.CLOSE], {}
            for i in range(len(x)):
                for j in range(i + 1, len(x)):
                    for k in range(j + 1, min(len(x), i + toxicity.SPAN + 1)):
                        out.setdefault((x[i], x[j], x[k]), []).append(toxicity.DECAY ** (k - i - 2))
            return out

        one, two = count(a), count(b)
        size = lambda c: sum(w * w for ws in c.values() for w in ws) ** 0.5
        return sum(sum(one[s]) * sum(two[s]) for s in one.keys() & two.keys()) / size(one) / size(two)

    words = ["blockhead", "bloxckhead", "dim", "dimwit", "a", "carpenter"]
    got = toxicity.kernel(words, words)
    assert np.allclose(got, [[by_hand(a, b) for b in words] for a in words])


@pytest.mark.parametrize("module, score", [(quality, "score_quality"), (toxicity, "score_toxicity")])
def test_very_long_texts(spark, module, score):
    """One word, one line of symbols and very many words, two million characters each."""
    rows = [(i, f"text {i} " + ("bad*** " * (i % 2))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    model = module.fit(docs, labels)
    long = spark.createDataFrame([(1, "x" * 2_000_000), (2, "*-" * 1_000_000), (3, "word " * 400_000), (4, "a b c d " * 250_000)], "doc_id bigint, text string")
    got = getattr(module, score)(long, model).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
