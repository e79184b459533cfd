import numpy as np
import pytest

from ratelake.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, whitened string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "other") for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    white = centred @ vecs[:, ::-1] / np.sqrt(values[::-1])
    return n, ((n * x - s) ** 2).sum(1), white, values[::-1] / values.sum()


@pytest.mark.parametrize("most", [4096, 7])
def test_equals_numpy(spark, monkeypatch, most):
    monkeypatch.setattr(whitening, "MOST_SUMS", most)
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + 3).tolist()
    got = whitening.whiten(table(spark, vectors)).toPandas()
    n, deviation, white, shares = brute(vectors)
    assert len(got) == 300 * 8 and set(got.n) == {n} and got.identity_error.max() < 1e-9
    for k in range(1, 9):
        part = got[got.component == k].set_index("vec_id").sort_index()
        mine = part.whitened.to_numpy()
        sign = np.sign(mine @ white[:, k - 1])
        assert np.allclose(mine, sign * white[:, k - 1], atol=1e-8) and np.allclose(part.explained, shares[k - 1])
        assert part.deviation.tolist() == deviation.tolist()


def test_query_over_whole_table(spark):
    d = "/root/testdata/sf0.01"
    got = whitening.op12_whitening(spark, d).toPandas()
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").toPandas().embedding.tolist()
    n, deviation, white, shares = brute([list(v) for v in vectors])
    assert len(got) == 8 * n and got.identity_error.max() < 1e-4
    first = got[got.component == 1].sort_values("vec_id")
    assert first.deviation.tolist() == deviation.tolist()
    assert np.allclose(np.abs(first.whitened), np.abs(white[:, 0]), atol=1e-6) and np.allclose(first.explained, shares[0])


def test_what_is_left_out(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [[1.0, 0.0], None, [nan, 1.0], [0.0, 1.0], [inf, 0.0], [None, 1.0], [-1.0, 3.0], [1.0, 0.0], [1.0, 2.0, 3.0], []]
    got = whitening.whiten(table(spark, vectors)).toPandas()
    assert sorted(set(got.vec_id)) == [0, 3, 6, 7] and set(got.component) == {1, 2} and set(got.n) == {4}
    a, b = (got[got.vec_id == i].set_index("component").whitened for i in (0, 7))
    assert np.allclose(a, b)


def test_nothing_to_whiten(spark):
    for vectors in ([], [None, [float("nan")]], [[]], [[2.0, 5.0]] * 3):
        out = whitening.whiten(table(spark, vectors))
        assert out.count() == 0
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_flat_direction_is_left_out(spark):
    got = whitening.whiten(table(spark, [[float(i), 2.0 * i, 1.0] for i in range(6)])).toPandas()
    assert set(got.component) == {1} and np.allclose(got.explained, 1.0)
