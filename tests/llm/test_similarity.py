import random

import pytest

from ratelake.llm import chunks, common, decontaminate, similarity, simhash
from ratelake.llm.components import components


def varied(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def jaccard(a, b):
    x, y = set(similarity.shingles(a).tolist()), set(similarity.shingles(b).tolist())
    return len(x & y) / len(x | y) if x or y else 0.0


def groups(texts, least=0.8):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= least:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def corpus(seed, families=8, size=5, length=120):
    rng, texts = random.Random(seed), [None, "", "  ", "one two", "One  two", "one two three"]
    for _ in range(families):
        base = [f"w{rng.randrange(3000)}" for _ in range(length)]
        texts += [" ".join(varied(rng, base, rng.choice([0, 1, 1, 2, 9]))) for _ in range(size)]
    return texts


@pytest.mark.parametrize("few, size", [(16, 5), (2, 9)])
def test_groups_equal_all_pairs(spark, monkeypatch, few, size):
    monkeypatch.setattr(similarity, "FEW", few)
    texts = corpus(few, size=size)
    df = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    found = {r["node"]: r["component"] for r in components(similarity.links(df)).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == groups(texts)
    assert len(set(groups(texts))) < len(texts)


def test_one_of_each_group_stays(spark):
    texts = corpus(3)
    rows = [(None if i == 9 else 1000 - i, t, i, "f", "r") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, text string, ROW int, fp string, __row string")
    got = similarity.keep_dissimilar(df, "id")
    root = groups(texts)
    best = {}
    for i, r in enumerate(root):
        key = (rows[i][0] is None, rows[i][0] or 0)
        best[r] = min(best.get(r, (key, i)), (key, i))
    assert got.columns == df.columns
    assert sorted(r["ROW"] for r in got.collect()) == sorted(i for _, i in best.values())
    assert similarity.keep_dissimilar(df.limit(0), "id").count() == 0


def test_bands_find_what_is_near_the_border():
    rng, hits, tries = random.Random(5), 0, 0
    while tries < 120:
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        a, b = " ".join(base), " ".join(varied(rng, base, 6))
        if 0.8 <= jaccard(a, b) <= 0.85:
            tries += 1
            hits += bool(set(similarity.band_keys(similarity.shingles(a))) & set(similarity.band_keys(similarity.shingles(b))))
    assert hits >= 116


def test_pairs_without_a_common_band_are_linked(spark):
    rng, missed = random.Random(8), []
    while len(missed) < 4:
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        a, b = " ".join(base), " ".join(varied(rng, base, 3))
        if 0.8 <= jaccard(a, b) < 0.82 and not set(similarity.band_keys(similarity.shingles(a))) & set(similarity.band_keys(similarity.shingles(b))):
            missed.append((a, b))
    others = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(120)) for _ in range(20)]
    texts = [t for pair in missed for t in pair] + others
    df = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    got = sorted((r["a"], r["b"]) for r in similarity.links(df).collect())
    assert got == [(0, 1), (2, 3), (4, 5), (6, 7)]


@pytest.mark.parametrize("seed", range(3))
def test_exact_join_alone_equals_all_pairs(spark, seed):
    rng, texts = random.Random(seed), []
    for _ in range(12):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.choice([5, 6, 9, 30, 60]))]
        texts += [" ".join(varied(rng, base, rng.choice([0, 1, 1, 2]))) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    sketches = similarity._sketches(df, 0.8)
    got = {(r["a"], r["b"]) for r in similarity._rest(sketches.select("row", "n", "least"), df, spark.createDataFrame([], "a bigint, b bigint"), 0.8).collect()}
    assert got == {(i, j) for j in range(len(texts)) for i in range(j) if jaccard(texts[i], texts[j]) >= 0.8}


def test_columns_with_clashing_names_stay(spark):
    names = ["__row", "__fp", "__text", "__cut", "row", "fp", "cut", "digest", "of"]
    passage = " ".join(f"common{i}" for i in range(40))
    rows = [(1, passage + " alpha", *names), (2, passage + " alpha", *names), (3, "before " + passage + " beta", *names), (4, "nothing", *names)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(7, "before common0 common1 common2 common3 common4 common5")], "item_id bigint, text string")
    for out, ids in ((simhash.keep_one(df), {1, 3, 4}), (chunks.remove_later_passages(df), {1, 2, 3, 4}), (decontaminate.drop_contaminated(df, bench), {1, 2, 4}), (similarity.keep_dissimilar(df), {1, 4})):
        got = out.collect()
        assert out.columns == df.columns and {r["doc_id"] for r in got} == ids and all(tuple(r[2:]) == tuple(names) for r in got)


def test_free_names():
    assert common.free("row", ["id"]) == "row" and common.free("row", ["Row", "row_1"]) == "row_2"
