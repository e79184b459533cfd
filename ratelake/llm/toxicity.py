"""Toxicity: a support vector machine with a subsequence string kernel on Nyström landmarks.

The kernel counts three-letter subsequences of a word, gaps allowed and discounted, with marks for the word's
ends; an insult with inserted, dropped or changed letters keeps most of them. Landmarks are words; the machine is
linear in the kernels with the landmarks, whitened by Nyström, and trained with an epsilon-insensitive loss on
how much a word speaks for the label. The examples are words, not sentences: labels are given for whole documents, in
which most sentences of a toxic one are clean, so a word takes the log-odds of the labels of the documents it stands in
(copies of a document count once). The README has figures for the same kernel on windows of words. Training goes in
rounds: learn from the words that tell most and from common clean ones, then score all words and learn the highest
too, which are what an insult may be mixed up with. A document is judged by its three worst words.

The trained machine is one weight for each subsequence, so scoring a word is a few look-ups.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import labelled_sample

#: Letters a to z are 1 to 26, other characters share the rest; 0 opens a word and the last closes it.
LETTERS, OPEN, CLOSE = 48, 0, 47
SPAN, DECAY = 5, 0.6
LANDMARKS, ROUNDS = 384, 3
EPSILON, RIDGE, SHRINK, CAUTION = 0.1, 1e-6, 2.0, 1.5
THRESHOLD, SEED = 0.7, 3
#: Bounds of the sample to learn from, both parameters of ``fit``: labelled rows, and their words that tell nothing for the label, in a round.
MAX_TRAIN, MAX_WORDS = 20_000, 3000
#: Longest stretch of letters taken as one word; longer ones are seen through overlapping windows.
LONGEST = 24
CACHE = 1_000_000
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN + 1 - a)]

_RUN = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[ \n][^\W\d_](?![^\W\d_])){3,}")
#: Signs that stand for letters.
_SIGNS = str.maketrans("013457@$!|", "oieastasil")
#: Marks around a word that cannot stand for letters.
_MARKS = "".join(set(string.punctuation) - set("@$!|"))


def segments(token: str) -> list[str]:
    """The words of a lower-case token without spaces: runs of letters; if there are several, or signs between
    them, also all letters joined, and the letters with signs read as letters."""
    runs = _RUN.findall(token)
    if not runs:
        return []
    core = token[token.index(runs[0]) : token.rindex(runs[-1]) + len(runs[-1])]
    if len(runs) > 1:
        runs.append("".join(runs))
    if not token.isalpha() and len(read := "".join(_RUN.findall(token.translate(_SIGNS)))) > 1 and any(c in "013457@$!|" for c in core):
        runs.append(read)
    out = []
    for r in runs:
        out += [r] if len(r) <= LONGEST else [r[i : i + LONGEST] for i in range(0, len(r) - LONGEST // 2, LONGEST // 2)]
    return out


def spaced(text: str) -> list[str]:
    """Words written letter by letter."""
    return [re.sub(r"\s", "", m[0]) for m in _SPACED.finditer(text)]


def letters(words: list[str]) -> np.ndarray:
    """Letter numbers of words, with end marks; -1 after a word's end."""
    width = max(map(len, words), default=0) + 1
    codes = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width).astype(np.int32)
    plain = codes - 96
    own = np.where((plain >= 1) & (plain <= 26), plain, 27 + codes % 20)
    place = np.arange(width)
    size = np.fromiter(map(len, words), np.int32, len(words))[:, None]
    own = np.where(place < size, own, np.where(place == size, CLOSE, -1))
    return np.hstack((np.full((len(words), 1), OPEN), own))


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, weights) of each word's subsequences; weights are scaled to length one, absent ones are 0."""
    x = letters(words)
    n = x.shape[1]
    pad = np.pad(x, ((0, 0), (0, SPAN)), constant_values=-1)
    numbers, weights = [], []
    for a, b in GAPS:
        three = pad[:, a + b : a + b + n]
        there = three >= 0
        numbers.append(np.where(there, (x * LETTERS + pad[:, a : a + n]) * LETTERS + three, 0))
        weights.append(there * DECAY ** (a + b - 2))
    number, weight = np.concatenate(numbers, 1), np.concatenate(weights, 1)
    return number, weight / np.maximum(np.sqrt((weight**2).sum(1, keepdims=True)), 1e-9)


#: Words are scored together with others of about their length.
LENGTHS = (4, 7, 10, 14, 19, 10_000)


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    """Kernel of each of ``words`` with each of ``others``."""
    number, weight = subsequences(words)
    out = np.empty((len(words), len(others)))
    for j, (num, wgt) in enumerate(zip(*subsequences(others), strict=True)):
        table = np.bincount(num, wgt, LETTERS**3)
        out[:, j] = (table[number] * weight).sum(1)
    return out


@dataclass
class Model:
    table: np.ndarray
    bias: float
    #: Of the three worst words, and the offset.
    weights: np.ndarray | None = None
    #: Log-odds of the label without any word.
    prior: float = 0.0
    constant: float | None = None

    def raw(self, words: list[str]) -> np.ndarray:
        out, size, low = np.full(len(words), self.bias), np.fromiter(map(len, words), np.int64, len(words)), -1
        for high in LENGTHS:
            some = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                number, weight = subsequences([words[i] for i in part])
                out[part] += (self.table[number] * weight).sum(1)
            low = high
        return out

    def chance(self, worst_words: np.ndarray) -> np.ndarray:
        """The larger of what the three worst words say together and, with caution, the worst by itself: texts for
        training rarely hold one insult alone, so their weights alone would excuse it."""
        together = worst_words @ self.weights[:-1] + self.weights[-1]
        alone = worst_words[:, 0] + self.prior - CAUTION
        return 1 / (1 + np.exp(-np.clip(np.maximum(together, alone), -40, 40)))


def train_words(words: list[str], target: np.ndarray, weight: np.ndarray) -> Model:
    """Support vector regression of the targets on the kernels with landmarks (squared epsilon-insensitive loss)."""
    rng = np.random.default_rng(SEED)
    high = np.argsort(-target, kind="stable")[: LANDMARKS // 2]
    rest = np.setdiff1d(np.arange(len(words)), high)
    marks = [words[i] for i in np.concatenate((high, rng.permutation(rest)[: LANDMARKS - len(high)]))]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    some = values > 1e-6
    white = vectors[:, some] / np.sqrt(values[some])
    x = np.hstack((kernel(words, marks) @ white, np.ones((len(words), 1))))
    bad = target > 1
    weight = np.where(bad, weight / max(1e-9, weight[bad].sum()), weight / max(1e-9, weight[~bad].sum()))
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-9
    for _ in range(30):  # Newton steps on the rows outside the tube
        gap = x @ w - target
        out = np.abs(gap) > EPSILON
        xa, wa = x[out], weight[out]
        new = np.linalg.solve((xa * wa[:, None]).T @ xa + np.diag(ridge), xa.T @ (wa * (target[out] + np.sign(gap[out]) * EPSILON)))
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    beta = white @ w[:-1]
    table = np.zeros(LETTERS**3)
    for b, num, wgt in zip(beta, *subsequences(marks), strict=True):
        table += b * np.bincount(num, wgt, LETTERS**3)
    return Model(table, float(w[-1]))


#: What this process knows: score of each word, score of each token, worst word of each token above 0; for one model.
_scored: dict[str, float] = {}
_seen: dict[str, float] = {}
_word: dict[str, str] = {}
_seen_by: list = [None]


def _learn(tokens: list[str], model: Model) -> None:
    """Score new tokens; a word that several tokens hold is scored once."""
    single, other, words = [], [], set()
    for t in tokens:
        core = t.strip(_MARKS)
        if core.isalpha() and len(core) <= LONGEST:
            single.append((t, core))
            words.add(core)
        else:
            other.append((t, parts := segments(t)))
            words.update(parts)
    new = [w for w in words if w not in _scored]
    _scored.update(zip(new, model.raw(new).tolist(), strict=True))
    for t, word in single:
        _seen[t] = value = _scored[word]
        if value > 0:
            _word[t] = word
    for t, parts in other:
        word = max(parts, key=_scored.__getitem__, default=None)
        _seen[t] = value = _scored[word] if word else 0.0
        if value > 0:
            _word[t] = word


def worst(texts: list[str | None], model: Model) -> np.ndarray:
    """Scores of the three worst different words of each text, 0 at least."""
    mark = (model.bias, float(model.table.sum()))
    if _seen_by[0] != mark or len(_seen) > CACHE:
        for known in (_scored, _seen, _word):
            known.clear()
        _seen_by[0] = mark
    sets = [tokens_of(t) for t in texts]
    _learn(list(set().union(*sets).difference(_seen)), model)
    out = np.zeros((len(sets), 3))
    for i, s in enumerate(sets):
        bad = {_word[t]: _seen[t] for t in s if t in _word}
        if bad:
            top = sorted(bad.values(), reverse=True)[:3]
            out[i, : len(top)] = top
    return out


def tokens_of(text: str | None) -> set[str]:
    """Lower-case tokens of a text, and its words written letter by letter."""
    low = (text or "").lower()
    out = set(low.split())
    if sum(len(t) == 1 and t.isalpha() for t in out) >= 3:
        out.update(spaced(low))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN, most_words: int = MAX_WORDS) -> Model:
    """Learn from at most ``most`` labelled documents outside the held-out fold: from all their words that tell for the label,
    and in each round from at most ``most_words`` others, as examples of what is clean. Word counts and worst words are Spark aggregates; only these words,
    and one score for each labelled document of the sample, reach the driver."""

    def split(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"y": [], "keys": [], "words": []}
        for y, text in zip(batch["y"], batch[text_col], strict=True):
            out["y"].append(y)
            out["keys"].append(copy_keys(text))
            out["words"].append(sorted({s for t in tokens_of(text) for s in segments(t) if len(s) > 1}))
        return out

    sample = labelled_sample(docs, labels, label, most, id_col, text_col)
    each = common.map_arrow(sample, split, "y int, keys array<bigint>, words array<string>", 128)
    each = common.materialize(each.withColumn("row", F.monotonically_increasing_id()), "labelled")
    words = common.materialize(each.join(_copies(each), "row").select("id", "y", F.explode("words").alias("word")).distinct(), "words")
    counts = words.groupBy("word").agg(F.countDistinct(F.when(F.col("y") == 1, F.col("id"))).alias("bad"), F.countDistinct("id").alias("n"))
    counts = common.materialize(counts, "counts")
    total = words.select("id", "y").distinct().agg(F.avg("y").alias("share"), F.count("*").alias("n")).first()
    if not total["n"] or total["share"] in (0.0, 1.0):
        return Model(np.zeros(LETTERS**3), 0.0, constant=total["share"] if total["n"] else 0.5)
    share = total["share"]
    # Minus the log of the chance that a word's documents all have label 1; of very many words some are lucky.
    tells = F.col("bad") * F.log(F.col("bad") / (F.col("n") * share))
    need = math.log(counts.count()) + 3
    prior = math.log(share / (1 - share))
    odds = F.log((F.col("bad") + SHRINK * share) / (F.col("n") - F.col("bad") + SHRINK * (1 - share))) - prior
    rated = counts.select("word", "n", odds.alias("odds"), F.when(F.col("bad") >= 0.5 * F.col("n"), tells).otherwise(0.0).alias("tells"))
    clean = rated.where("odds < 0")
    picks = [
        rated.where(F.col("tells") > need).orderBy(F.desc("tells"), "word"),
        clean.orderBy(F.desc("n"), "word").limit(most_words // 2), clean.orderBy(F.xxhash64("word"), "word").limit(most_words // 2),
    ]
    learned = {r["word"]: (r["odds"], r["n"]) for p in picks for r in p.collect()}
    for left in reversed(range(ROUNDS)):
        some = sorted(learned)
        odds_of, n_of = (np.array([learned[w][i] for w in some], float) for i in (0, 1))
        model = train_words(some, odds_of, np.sqrt(np.minimum(n_of, 100)))
        if left:

            def rate(batch: dict[str, list], model: Model = model) -> dict[str, list]:
                return batch | {"raw": model.raw(batch["word"]).tolist()}

            high = common.map_arrow(rated.select("word", "odds", "n"), rate, "word string, odds double, n bigint, raw double", 4096)
            high = high.where(F.col("n") > 1).orderBy(F.desc("raw"), "word").limit(most_words // 2)
            learned |= {r["word"]: (r["odds"], r["n"]) for r in high.collect()}

    def judge(batch: dict[str, list]) -> dict[str, list]:
        return {"y": batch["y"], "top": worst(batch[text_col], model).tolist()}

    judged = common.map_arrow(sample, judge, "y int, top array<double>", 256).toArrow()
    top = np.asarray(judged.column("top").to_pylist(), float).reshape(-1, 3)
    model.prior = prior
    model.weights = platt(top, np.asarray(judged.column("y").to_pylist(), float))
    return model


def copy_keys(text: str | None) -> list[int]:
    """Three least hashes of the text's five-word shingles; near copies have most of them in common."""
    tokens = (text or "").lower().split()
    shingles = [" ".join(tokens[i : i + 5]).encode("utf-8", "replace") for i in range(max(1, len(tokens) - 4))]
    return [min(xxhash.xxh64_intdigest(s, seed) >> 1 for s in shingles) for seed in (1, 2, 3)]


def _copies(each: DataFrame) -> DataFrame:
    """row, id for ``each`` (row, keys): documents with two of the three keys in common are copies and count as one. A
    shared passage may give two documents one key, hardly two. Of several groups a document is in the largest."""
    pairs = F.array(*(F.xxhash64(F.lit(i), F.col("keys")[i], F.col("keys")[(i + 1) % 3]) for i in range(3)))
    keys = each.select("row", F.explode(pairs).alias("key"))
    often = keys.groupBy("key").agg(F.count("*").alias("n"))
    return keys.join(often, "key").groupBy("row").agg(F.max(F.struct("n", "key")).alias("top")).select("row", F.col("top.key").alias("id"))


def platt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset of the chance of label 1, by Newton steps with smoothed targets; no weight is negative."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.c_[x, np.ones(len(x))]
    on = np.ones(x.shape[1], bool)
    while True:
        w, small = np.zeros(x.shape[1]), x[:, on]
        for _ in range(80):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (small * (p * (1 - p))[:, None]).T @ small + 1e-3 * np.eye(small.shape[1])
            step = np.linalg.solve(hessian, small.T @ (p - target) + 1e-3 * w[on])
            w[on] -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        if not (w[:-1] < 0).any():
            return w
        on[:-1] &= w[:-1] >= 0


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.7), one row per input row.

    Every word of every text is seen, a token's signs and gaps read both ways. Null and empty texts score as a text without words; very long ones are
    read whole; null ids and repeated rows are kept, and an empty table gives an empty one. Without two classes among the labels every score is their mean (0.5 without labels).
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one weight for each subsequence, whatever the data

    def work(rows: dict[str, list]) -> dict[str, list]:
        m = shared.value
        score = np.full(len(rows[id_col]), m.constant) if m.constant is not None else m.chance(worst(rows[text_col], m))
        return {id_col: rows[id_col], "score": score.tolist(), "predicted": (score >= THRESHOLD).astype(int).tolist()}

    return common.map_arrow(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, score double, predicted int", 256)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", common.held_out("doc_id").alias("held_out"), "score", "predicted")
