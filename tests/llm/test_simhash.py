import random

import pytest
import xxhash

from ratelake.llm import simhash
from ratelake.llm.components import components


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near_groups(seed):
    """Fingerprints in groups a few bits apart, some groups dense in one half."""
    rng, out = random.Random(seed), set()
    for base in [rng.getrandbits(64) for _ in range(4)]:
        for width, flips, n in ((64, 4, 40), (32, 3, 60)):
            for _ in range(n):
                x = base
                for _ in range(rng.randint(0, flips)):
                    x ^= 1 << rng.randrange(width)
                out.add(signed(x))
    return sorted(out)


def brute(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("dense", [48, 2])
def test_components_equal_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    fps = near_groups(5)
    want = brute(fps)
    got = {r[0]: r[1] for r in components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))).collect()}
    assert {f: got.get(f, f) for f in fps} == want
    assert len(set(want.values())) < len(fps)


@pytest.mark.parametrize("text", ["", "   ", "One", "one two", "a b c", "The cat\tsat on\nthe MAT " * 9000, "é É ß"])
def test_fingerprint_equals_definition(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in low.replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    want = sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64)) if hashes else 0
    assert simhash.fingerprint(text) == want


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a b c d", "z"), (None, "a b c d", "z"), (None, "hello you all here", "z"), (3, "hello there my friend", "q"), (3, "hello there my friend", "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, None), (None, None), (None, None)], key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, None), (3, "hello there my friend"), (None, "a b c d"), (None, "hello you all here")], key=str)
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_one_id_with_two_texts_keeps_both_groups(spark):
    one, two = "hello there my friend", "something else that is entirely different from it"
    docs = spark.createDataFrame([(3, one), (3, two), (1, two), (4, one)], "doc_id bigint, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [(1, two), (3, one)]
