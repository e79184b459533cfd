import random

import numpy as np

from ratelake.llm import chunks


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_cuts_move_with_the_text():
    rng = random.Random(1)
    text = prose(rng, 400)
    plain = set(map(tuple, chunks.chunks_of(text)[2].tolist()))
    shifted = set(map(tuple, chunks.chunks_of("an insertion at the front, " + text)[2].tolist()))
    assert len(plain - shifted) <= 2


def test_chunks_cover_and_have_a_largest_size(monkeypatch):
    for text in ("", "a", "x" * 5000, "é" * 700, prose(random.Random(2), 900)):
        starts, ends, digests = chunks.chunks_of(text)
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(starts, ends)) == raw
        assert len(digests) == len(starts) and all(0 < b - a <= chunks.MOST for a, b in zip(starts, ends))
    text = prose(random.Random(3), 2000)
    whole = [x.tolist() for x in chunks.chunks_of(text)]
    monkeypatch.setattr(chunks, "PIECE", 1 << 10)
    assert [x.tolist() for x in chunks.chunks_of(text)] == whole


def brute(texts):
    """Documents with a run of chunks of at least MIN_PASSAGE bytes that occur more than once, by plain counting."""
    count, out = {}, {}
    parts = [chunks.chunks_of(t) for t in texts]
    raw = [(t or "").encode() for t in texts]
    for r, (a, b, _) in zip(raw, parts):
        for x, y in zip(a, b):
            count[r[x:y]] = count.get(r[x:y], 0) + 1
    for i, (r, (a, b, _)) in enumerate(zip(raw, parts)):
        flags = np.array([count[r[x:y]] > 1 for x, y in zip(a, b)], bool)
        spans, k = [], 0
        while k < len(flags):
            if flags[k]:
                j = k
                while j + 1 < len(flags) and flags[j + 1]:
                    j += 1
                if b[j] - a[k] >= chunks.MIN_PASSAGE:
                    spans.append((int(a[k]), int(b[j])))
                k = j
            k += 1
        if spans:
            out[i] = spans
    return out


def test_equals_counting(spark):
    rng = random.Random(7)
    shared = [prose(rng, 60) for _ in range(3)]
    texts = [None, "", "short", *(prose(rng, 80) for _ in range(20))]
    texts += [prose(rng, 30) + " " + rng.choice(shared) + " " + prose(rng, 30) for _ in range(15)]
    texts += [texts[5], texts[5], prose(rng, 10) * 12]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, row string").repartition(3)
    got = {r["doc_id"]: sorted((p["start"], p["end"]) for p in r["passages"]) for r in chunks.repeated_passages(docs).collect()}
    assert got == brute(texts)
    assert set(range(23, 38)) <= set(got) and not set(range(6, 23)) & set(got)


def test_first_holder_keeps_its_passage(spark):
    text = prose(random.Random(9), 100)
    docs = spark.createDataFrame([(5, text), (2, text), (None, text)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["removed_bytes"], r["passages"][0]["first_id"]) for r in chunks.repeated_passages(docs).collect()}
    assert got[2] == (0, 2) and got[5] == (len(text), 2) and got[None] == (len(text), 2)
    assert chunks.repeated_passages(docs.where("false")).count() == 0


def test_later_passages_are_cut(spark):
    rng = random.Random(4)
    passage, own = prose(rng, 80), [prose(rng, 60) for _ in range(3)]
    rows = [(i, f"{own[i]} {passage} {own[i][::-1]}", "x") for i in range(3)] + [(9, None, "n"), (None, own[0][:300] + "é" * 40, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, later string")
    out = chunks.remove_later_passages(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[0] == rows[0][1] and got[9] is None and len(got[None]) < len(rows[4][1])
    for i in (1, 2):
        assert len(rows[i][1]) - len(got[i]) > 0.8 * len(passage) and got[i].startswith(own[i][:300]) and got[i].endswith(own[i][::-1][-300:])
    assert chunks.remove_later_passages(docs.where("false")).count() == 0
