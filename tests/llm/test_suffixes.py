import hashlib
import random
from collections import Counter

import pytest

from ratelake.llm import suffixes


def brute(texts, depth):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + depth] for r in raw for i in range(len(r) - depth + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - depth + 1):
            if seen[r[i : i + depth]] > 1:
                gone[i : i + depth] = [True] * depth
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    """Copies, near copies, shared passages at many offsets, periodic texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, base = [prose(25) for _ in range(4)], prose(90)
    texts = [None, "", "short", base, base, "ab" * 150, "ab" * 90 + prose(10), "a" * 300]
    for _ in range(40):
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    for _ in range(60):
        p = rng.choice(shared)
        cut = rng.randrange(len(p) // 2)
        texts.append(prose(rng.randint(0, 30)) + p[cut : cut + rng.randint(30, 120)] + prose(rng.randint(0, 30)))
    return texts


@pytest.mark.parametrize(("seed", "in_task"), [(1, 512), (2, 3), (3, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, in_task):
    monkeypatch.setattr(suffixes, "IN_TASK", in_task)
    monkeypatch.setattr(suffixes, "DIGIT", 17)
    monkeypatch.setattr(suffixes, "WIDTHS", (16, 4, 1))
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("row", docs_row())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(docs, 50).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 50)


def docs_row():
    from pyspark.sql import functions as F

    return F.lit("a clashing column")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffixes.remove_repeats(docs).count() == 0


def test_long_text_in_pieces(monkeypatch):
    import numpy as np

    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    whole = suffixes.stretches(data, 60)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    parts = suffixes.stretches(data, 60)
    expand = lambda s: [(g, f + k, f + a) for g, f, n, a in zip(s[0], s[3], s[4], s[5]) for k in range(n)]
    assert expand(whole) == expand(parts)


def test_a_digit_with_very_many_classes_is_dealt_to_several_tasks(spark):
    from pyspark.sql import functions as F

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    held = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        # One gram in half of the rows, each stretch of its own; the others in twos, every other pair equal as a whole.
        gram = F.when(F.col("id") < 20000, F.lit(7)).otherwise(F.floor(F.col("id") / 2) + 100)
        kind = F.when((F.col("id") >= 20000) & (F.floor(F.col("id") / 2) % 2 == 0), F.floor(F.col("id") / 2)).otherwise(F.col("id"))
        runs = spark.range(0, 40000, 1, 8).withColumns({"gram": gram, "u1": F.xxhash64(kind), "u2": F.xxhash64(kind, F.lit(1))})
        runs = runs.selectExpr("gram", "u1", "u2", "id AS row", "0 AS first", "3 AS n", "2 AS at")
        spans, unlike = suffixes._settle(runs)
        rows = unlike.collect()
        assert "skew=true" in unlike._jdf.queryExecution().executedPlan().toString()
        assert Counter(r["gram"] for r in rows)[7] == 20000 and {r["classes"] for r in rows if r["gram"] == 7} == {20000}
        assert len(rows) == 30000 and sorted(r["row"] for r in rows if r["gram"] != 7) == [i for i in range(20000, 40000) if i // 2 % 2]
        assert sorted(r["row"] for r in spans.collect()) == [i for i in range(20000, 40000) if not i // 2 % 2]
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
