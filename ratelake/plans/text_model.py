"""A baseline text classifier on Spark ML, judged on a split or by cross-validation."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ratelake.operators.splits import folds

FEATURES = 1 << 14
NAMES = ("words", "pairs")
#: Counts that fewer documents have are not learnt from.
LEAST_DOCUMENTS = 2


def features(rows: DataFrame) -> DataFrame:
    """``rows`` (with text) with one vector of hashed counts of words and of word pairs in place of the text, made once: whatever learns from them
    reads no text again. Vectors are kept on the executors' disks (Parquet reads them value by value, which takes several times as long),
    as memory is for the rows of the regression; to be unpersisted."""
    even = rows.hint("rebalance").withColumn("text", F.coalesce("text", F.lit("")))  # every step of a fit waits for its largest part, and pays for empty ones
    out = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+").transform(even)
    out = NGram(n=2, inputCol="words", outputCol="pairs").transform(out)
    for name in NAMES:
        out = HashingTF(numFeatures=FEATURES, inputCol=name, outputCol=f"{name}_n").transform(out)
    out = VectorAssembler(inputCols=[f"{n}_n" for n in NAMES], outputCol="counts").transform(out)
    return out.select(*(c for c in rows.columns if c != "text"), "counts").persist(StorageLevel.DISK_ONLY)


def documents_with(rows: DataFrame) -> tuple[int, np.ndarray]:
    """How many ``rows`` there are (one at least), and how many of them have each feature."""
    model = IDF(inputCol="counts", outputCol="weighed").fit(rows)
    return model.numDocs, np.asarray(model.docFreq)


def rarity(parts: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
    """Spark's inverse document frequency over several parts, each counted by ``documents_with``."""
    n, having = (sum(p) for p in zip(*parts, strict=True))
    return np.where(having >= LEAST_DOCUMENTS, np.log((n + 1) / (having + 1.0)), 0.0)


def judge(train: DataFrame, test: DataFrame, sizes: dict, weights: np.ndarray) -> DataFrame:
    """``test`` with prediction, after a logistic regression with balanced classes on counts times ``weights`` (both with label and the counts of
    ``features``); ``sizes`` are the rows of each label in ``train``. The regression keeps its rows in memory, so nothing else does."""
    total = sum(sizes.values())
    weight = F.lit(1.0)
    for label, n in sizes.items():
        weight = F.when(F.col("label") == label, total / (len(sizes) * n)).otherwise(weight)
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="counts", outputCol="features")
    learnt = weigh.transform(train).select(F.col("label").cast("double").alias("label"), weight.alias("weight"), "features")
    model = LogisticRegression(weightCol="weight", maxIter=20, regParam=0.01).fit(learnt)
    return model.transform(weigh.transform(test))


def sizes_by(parted: DataFrame, part: str) -> dict:
    """For each value of ``part``, the rows of each label."""
    out: dict = {}
    for r in parted.groupBy(part, "label").count().collect():  # one row for each part and class
        out.setdefault(r[part], {})[r["label"]] = r["count"]
    return out


def evaluate_baseline(rows: DataFrame) -> DataFrame:
    """One row (n_train, n_test, n_correct) for ``rows`` (doc_id, text, label); the split goes by a hash of the id, so it stays the same."""
    made = features(rows.where("label IS NOT NULL").withColumn("test", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0))
    train, sizes = made.where("NOT test"), sizes_by(made, "test")[False]
    done = judge(train, made.where("test"), sizes, rarity([documents_with(train)]))
    r = done.agg(F.count("*").alias("n"), F.sum((F.col("prediction") == F.col("label")).cast("bigint")).alias("n_correct")).first()  # one row
    made.unpersist()
    return rows.sparkSession.createDataFrame([(sum(sizes.values()), r["n"], r["n_correct"])], "n_train bigint NOT NULL, n_test bigint NOT NULL, n_correct bigint")


def cross_validate(rows: DataFrame, k: int = 3) -> DataFrame:
    """fold, n, n_correct and accuracy of each of ``k`` folds of ``rows`` (doc_id, text, label), each judged by what the others teach.

    Folds are exact shares of every class by hash rank, so scores repeat; classes with fewer than ``k`` rows are learnt in
    every fold and judged in none. Features are made once, and documents that have a feature are counted once for each fold: what
    the other folds hold is a sum.
    """
    parted = features(folds(rows.where("label IS NOT NULL"), "label", "doc_id", k))
    sizes = sizes_by(parted, "fold")
    counted = {i: documents_with(parted.where(F.col("fold").eqNullSafe(F.lit(i)))) for i in sizes}
    scores = []
    for i in range(k):
        others = [j for j in sizes if j != i]
        classes = {label: sum(sizes[j].get(label, 0) for j in others) for label in {label for j in others for label in sizes[j]}}
        done = judge(parted.where(F.coalesce(F.col("fold") != i, F.lit(True))), parted.where(F.col("fold") == i), classes, rarity(counted[j] for j in others))
        r = done.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("prediction") == F.col("label")).cast("bigint")), F.lit(0)).alias("n_correct")).first()
        scores.append((i, r["n"], r["n_correct"]))  # one row a fold
    parted.unpersist()
    out = rows.sparkSession.createDataFrame(scores, "fold int, n bigint, n_correct bigint")
    return out.withColumn("accuracy", F.round(F.try_divide("n_correct", "n"), 6))
