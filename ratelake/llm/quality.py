"""Quality classifier: random-indexing word vectors pooled per document, then a small two-layer network.

Word vectors are sums of the sparse random index vectors of neighbouring words, gathered over all documents.
Words are hashed into a fixed number of buckets, so the table of vectors has one size at any scale. Next to
each word stands its shape (case, length class, kind of mark, said again or not), a word of its own. The network
learns from a bounded sample of labelled rows outside the held-out fold; part of the sample sets the
temperature that calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, SHAPES, DIM, NONZERO = 4096, 256, 32, 4
HIDDEN = 24
#: Labelled rows the network learns from at most.
MAX_TRAIN = 6000
THRESHOLD = 0.5
SEED = 11
#: Words whose bucket and shape a task remembers at most.
CACHE = 100_000
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero entries of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def shape_of(token: str) -> int:
    """0..127: the kind of token, its case and its length class."""
    size = min(3, len(token).bit_length() - 1)
    if token[0].isalpha():
        case = 0 if token.islower() else 1 if token.istitle() else 2 if token.isupper() else 3
        return case * 4 + size
    if token[0].isdigit():
        return 16 + size
    return 20 + zlib.crc32(token[0].encode("utf-8", "replace")) % 27 * 4 + size


class Words:
    """Bucket and shape of each token of a text."""

    def __init__(self) -> None:
        self.recent = common.Recent(CACHE)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = _WORD.findall(text)
        new = self.recent.missing(set(tokens))
        known = self.recent.known
        for t in new:
            bucket = SHAPES + zlib.crc32(t.lower().encode("utf-8", "replace")) % (BUCKETS - SHAPES)
            known[t] = bucket << 8 | shape_of(t)
        both = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        words, shapes = both >> 8, both & 255
        shapes[1:] += (words[1:] == words[:-1]) * (SHAPES // 2)
        return words, shapes


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float
    #: Without two classes to learn from: the only score there is.
    constant: float | None = None

    def score(self, pooled: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(pooled), self.constant)
        return 1 / (1 + np.exp(-np.clip(forward(self.layers, (pooled - self.mean) / self.scale)[1] / self.temperature, -40, 40)))


def forward(layers: tuple[np.ndarray, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Vectors of all buckets, from every document. Each task adds up one small table of whole numbers; Spark adds the
    tables, so the sums do not depend on how rows are dealt."""
    at, sign = index_vectors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(BUCKETS * DIM)

        def flush(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
            if not pairs:
                return
            centre, near = (np.concatenate(x) for x in zip(*pairs, strict=True))
            for k in range(NONZERO):
                total[:] += np.bincount(centre * DIM + at[near, k], sign[near, k], BUCKETS * DIM)

        for batch in batches:
            pairs, held = [], 0
            for text in batch.column(0):
                w, s = words(text.as_py() or "")
                for a, b in ((w, w), (s, s)):
                    pairs += [(a[1:], b[:-1]), (a[:-1], b[1:])]
                held += len(w)
                if held > 200_000:
                    flush(pairs)
                    pairs, held = [], 0
            flush(pairs)
        table = total.reshape(BUCKETS, DIM)
        used = np.flatnonzero(np.abs(table).sum(1))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "v": pa.array(table[used].astype(np.int64).tolist(), pa.list_(pa.int64()))})

    parts = docs.select(F.col(text_col)).mapInArrow(run, "bucket int, v array<bigint>")
    sums = parts.groupBy("bucket").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(DIM))).alias("v"))
    out = np.zeros((BUCKETS, DIM))
    for r in sums.collect():  # at most one row for each bucket
        out[r["bucket"]] = r["v"]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.round(out, 3) / np.where(norm > 0, norm, 1)
    np.add.at(out, (np.arange(BUCKETS)[:, None], at), sign / np.sqrt(NONZERO))
    return out


def pool(vectors: np.ndarray, words: Words, text: str) -> np.ndarray:
    """Mean vector of the words and mean vector of the shapes; zeros for a text without words."""
    w, s = words(text)
    n = max(1, len(w))
    return np.concatenate((np.bincount(w, minlength=BUCKETS) @ vectors, np.bincount(s, minlength=SHAPES) @ vectors[:SHAPES])) / n


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    """The network, by full-batch Adam on four fifths of the rows; the rest sets the temperature."""
    model = Model(vectors, np.zeros(2 * DIM), np.ones(2 * DIM), (), 1.0)
    if len(set(y.tolist())) < 2 or len(y) < 10:
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    x = (x - model.mean) / model.scale
    rng = np.random.default_rng(SEED)
    # A fifth of each class, one row at least where it has two.
    own = np.ones(len(y), bool)
    for k in (0, 1):
        some = rng.permutation(np.flatnonzero(y == k))
        own[some[: max(len(some) // 5, int(len(some) > 1))]] = False
    layers = [rng.normal(0, 1 / np.sqrt(2 * DIM), (2 * DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for step in range(1, 301):
        hidden, logit = forward(tuple(layers), x[own])
        d = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[own]) / own.sum()
        back = np.outer(d, layers[2]) * (1 - hidden**2)
        grads = [x[own].T @ back + 1e-3 * layers[0], back.sum(0), hidden.T @ d + 1e-3 * layers[2], d.sum()]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            layers[i] = layers[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model.layers = tuple(layers)
    rest = ~own
    logit = forward(model.layers, x[rest])[1]
    grid = np.geomspace(0.25, 8, 41)
    loss = [np.logaddexp(0, -np.where(y[rest] == 1, 1, -1) * logit / t).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and label of at most ``most`` labelled documents outside the held-out fold, chosen by a hash of the id.
    Labels of ids that ``docs`` does not have are left out before the choice, null ids and labels too. One row an id: an
    id labelled several times has its largest label, one of several rows its smallest text."""
    some = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~common.held_out(id_col))
    some = some.groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("y")).join(docs.select(id_col), id_col, "left_semi")
    some = some.orderBy(F.xxhash64(id_col), id_col).limit(most)
    rows = docs.select(id_col, text_col).join(F.broadcast(some), id_col)  # at most ``most`` narrow rows
    return rows.groupBy(id_col).agg(F.min(text_col).alias(text_col), F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> Model:
    """Word vectors over all of ``docs``; the network from at most ``most`` labelled rows outside the held-out fold."""
    vectors = word_vectors(docs, text_col)
    words = Words()

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {"id": rows[id_col], "y": rows["y"], "x": [pool(vectors, words, t or "").tolist() for t in rows[text_col]]}

    rows = common.map_arrow(labelled_sample(docs, labels, label, most, id_col, text_col), work, "id bigint, y int, x array<double>").toArrow()
    rows = rows.sort_by("id")
    x = np.asarray(rows.column("x").to_pylist(), float).reshape(-1, 2 * DIM)
    return train(vectors, x, np.asarray(rows.column("y").to_pylist(), float))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5), one row per input row.

    Null and empty texts get the score of a text without words; null ids and repeated rows are kept; other
    columns are not read. Without two classes among the labels, every score is their mean (0.5 without labels).
    Very long texts are read whole. An empty table gives no rows.
    """
    words = Words()

    def work(rows: dict[str, list]) -> dict[str, list]:
        pooled = np.asarray([pool(model.vectors, words, t or "") for t in rows[text_col]]).reshape(-1, 2 * DIM)
        score = model.score(pooled)
        return {id_col: rows[id_col], "score": score.tolist(), "predicted": (score >= THRESHOLD).astype(int).tolist()}

    kind = dict(docs.dtypes)[id_col]
    return common.map_arrow(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the model does not reject, all columns as they are."""
    words = Words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = some.column(text_col).to_pylist()
                good = model.score(np.asarray([pool(model.vectors, words, t or "") for t in texts])) >= THRESHOLD
                yield some.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", common.held_out("doc_id").alias("held_out"), "score", "predicted")
