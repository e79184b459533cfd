import numpy as np
from pyspark.sql import functions as F

from ratelake.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, v string"


def brute(rows, k=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            s = (x * q).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def run(spark, rows):
    table = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "clash") for i, v in rows], SCHEMA).repartition(3)
    got = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 16))
    rows = [(i, centres[i % 30] + 0.2 * rng.standard_normal(16)) for i in range(3000)]
    want, got = brute(rows), run(spark, rows)
    assert set(got) == set(want)
    recall = np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    exact = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - exact[q][a]) < 1e-9 for q, v in got.items() for a, s in v if a in exact[q])


def test_equal_vectors_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    same = rng.standard_normal(16)
    rows = [(i, same) for i in range(200)] + [(200 + i, rng.standard_normal(16) * 0.1) for i in range(30)]
    rows += [(300, None), (320, [0.0] * 16), (340, [float("nan")] * 16), (360, [None] * 16), (380, [1.0] * 3), (None, same), (5, same)]
    want, got = brute(rows), run(spark, rows)
    assert set(got) == set(want)
    for q in (0, 20, 180):
        assert [a for a, _ in got[q]] == [i for i in range(22) if i != q][:20]


def test_few_rows_and_none(spark):
    rows = [(0, [1.0] * 16), (1, [2.0] * 16), (2, [-1.0] * 16)]
    assert run(spark, rows) == {0: [(1, 32.0), (2, -16.0)]}
    assert run(spark, []) == {}


def test_stretches_are_what_a_prefix_holds():
    rng = np.random.default_rng(3)
    keys = np.sort(np.concatenate((rng.integers(0, 1 << 40, 300), rng.integers(0, 1 << 12, 50), [0, (1 << 40) - 1])))
    of = np.concatenate((keys[::7], rng.integers(0, 1 << 40, 20)))
    for length in range(neighbours.BITS + 2):
        first, last = neighbours.stretch(keys, of, np.full(len(of), length))
        for q, a, b in zip(of, first, last):
            want = [] if length > 40 else [int(x) for x in keys if x >> (40 - length) == q >> (40 - length)]
            assert keys[a:b].tolist() == want


def test_clustered_vectors_need_not_meet_all_rows(spark, monkeypatch):
    """In blocks of a short array and in several steps, with no query left to the plain search."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, c / np.linalg.norm(c)) for i, c in ((i, centres[i % 60] + 0.03 * rng.standard_normal(16)) for i in range(3000))]
    monkeypatch.setattr(neighbours, "BLOCK", 256)
    monkeypatch.setattr(neighbours, "ENOUGH", 16)
    left = []
    plain = neighbours._all_rows
    monkeypatch.setattr(neighbours, "_all_rows", lambda data, asked, *more: left.append(asked.count()) or plain(data, asked, *more))
    want, got = brute(rows), run(spark, rows)
    assert sum(left) == 0 and len(left) > 1
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_doubles_are_scored_as_they_are(spark):
    rows = [(i, [0.1 + i * 1e-9, 1.0]) for i in range(40)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(39, 19, -1))
    assert got[0]["score"] == 0.1 * (0.1 + 39e-9) + 1.0


def test_cells_cut_by_rows_and_queries_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    one = rng.standard_normal(16)
    rows = [(i, one + 0.01 * rng.standard_normal(16)) for i in range(400)] + [(400 + i, rng.standard_normal(16)) for i in range(200)]
    whole = run(spark, rows)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 5)
    cut = run(spark, rows)
    assert {q: [a for a, _ in v] for q, v in cut.items()} == {q: [a for a, _ in v] for q, v in whole.items()}
