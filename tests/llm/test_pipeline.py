import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from ratelake.llm import decontaminate, packing, quality, secrets, simhash  # noqa: E402

D = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "benchmark", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D).cache()
        if name == "packing":
            assert out.select("doc_id").distinct().count() == docs.count()
            break
        assert out.columns == columns
        before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, out))
        gone = set(before) - set(after)
        if name == "quality":
            model = quality.fit(docs, spark.read.parquet(f"{D}/labels.parquet"))
            bad = {r["doc_id"] for r in quality.score_quality(docs, model).where(F.col("predicted") == 0).collect()}
            assert gone == bad and after == {k: v for k, v in before.items() if k in after}
        elif name == "near_copies":
            fps = {i: simhash.fingerprint(t or "") for i, t in before.items()}
            root = {i: i for i in fps}
            for i in sorted(fps):
                for j in sorted(fps):
                    if j < i and (fps[i] ^ fps[j]).bit_count() <= 2:
                        a, b = sorted((root[i], root[j]))
                        root = {k: a if v == b else v for k, v in root.items()}
            assert set(after) == {i for i in fps if root[i] == i}
        elif name == "benchmark":
            hits = decontaminate.contaminated(docs, spark.read.parquet(f"{D}/benchmark.parquet"))
            assert gone == {r["doc_id"] for r in hits.collect()}
        else:
            assert not gone and all(after[i] == secrets.redact(t, secrets.find_spans(t)) for i, t in before.items())
        docs = out


def test_run_gives_packed_pieces(spark):
    got = corpus_pipeline.run(spark, D)
    sizes = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert sizes and all(r["n"] == r["end"] <= packing.MAX_LEN for r in sizes)
