import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from ratelake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(40))
def test_plan_covers_every_token_once_without_padding(seed):
    rng = random.Random(seed)
    most = rng.choice([8, 16, 64, 2048])
    sizes = min(most - 1, rng.choice([1, 3, 40, 900]))
    histogram = {rng.randint(1, most - 1): rng.randint(1, rng.choice([1, 3, 500])) for _ in range(rng.randint(0, sizes))}
    plan, sequences = packing.plan_packs(histogram, most), defaultdict(list)
    for length, n in histogram.items():
        for rank in range(n):
            at = 0
            for start, size, sequence, offset in packing.place(plan, length, rank):
                assert start == at
                at += size
                sequences[sequence].append((offset, size))
            assert at == length
    for pieces in sequences.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end == most or end & (end - 1) == 0
    assert len(sequences) == plan.sequences


def test_histogram_packs_fill_longest_first():
    packs = packing.histogram_packs({6: 2, 4: 1, 2: 3}, 10)
    assert sum(n * (10 - left) for left, _, n in packs) == 22
    assert sum(n for _, _, n in packs) == 3
    assert all(parts[0][0] >= parts[-1][0] for _, parts, _ in packs)


TEXTS = ["", "Hello, world!", "a<|endoftext|>b end", "İstanbul ΣΑΣ naïve Ångström", "x́y 1.5%  don't\tstop\r\nit's ***bold*** ,,,...", "  wide​space", "漢字 and emoji 🙂!", "A" * 300 + " " + "b-c" * 200, "é" * 50 + "é end."]


def test_chunked_ids_equal_the_tokenizers():
    tokens = packing.ChunkTokenizer(PATH)
    for text, ids in zip(TEXTS, tokens(TEXTS), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_pieces_equal_the_documents(spark):
    rng = random.Random(3)
    words = ["tariff", "rider", "Energy,", "of", "zzzq"]
    texts = [*TEXTS, None, *(" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 700]))) for _ in range(60))]
    rows = [(None if i == 4 else i // 2, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rest string").repartition(3)
    got = packing.pack_documents(docs, PATH, 256).collect()
    tokenizer = packing.ChunkTokenizer(PATH).tokenizer
    want, have = Counter(), Counter()
    for doc, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc] += len(ids)
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end == 256 or end & (end - 1) == 0
    # Where one row has an id, its pieces must hold its very ids.
    single = {doc: text for doc, text, _ in rows if sum(d == doc for d, *_ in rows) == 1}
    for doc, text in single.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for r in (r for r in got if r["doc_id"] == doc):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_rare_words_do_not_fill_a_worker(monkeypatch):
    """What a worker remembers is bounded, words that keep coming back are learnt once, and ids are those of the tokenizer."""
    import tracemalloc

    from ratelake.llm import quality

    monkeypatch.setattr(packing, "CACHE", 2000)
    tokens = packing.ChunkTokenizer(PATH)
    learnt = []
    monkeypatch.setattr(tokens, "_learn", lambda chunks, learn=tokens._learn: (learnt.extend(chunks), learn(chunks)))
    for i in range(40):
        texts = [f"often  again, {' '.join(f'w{i}x{j}y{k},' for k in range(10))}" for j in range(64)]
        got = list(tokens(texts))
        assert len(tokens.recent.known) + len(tokens.recent.older) <= 3500
        assert got[5] == np.array(tokens.tokenizer.encode(texts[5], add_special_tokens=False).ids, "<u4").tobytes()
    assert learnt.count("often") == learnt.count("again,") == 1 and len(learnt) > 25_000

    words = quality.Words()
    tracemalloc.start()
    letters = str.maketrans("0123456789", "abcdefghij")
    for i in range(390):
        words(" ".join(map(str, range(i * 1000, i * 1000 + 1000))).translate(letters))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 25e6 and len(words.recent.known) + len(words.recent.older) <= quality.CACHE


def test_rare_words_of_letters_go_to_the_model_alone(monkeypatch):
    """No pass through normalizer and pre-tokenizer for a word that they leave as it is, and no look-up of words already known."""
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x61, 0x100) if chr(c).isalpha()]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts = [" ".join(["often", *(w + rng.choice(["", ",", ".", "!?"]) for w in words[at : at + 10])]) for at in range(0, 3000, 10)]
    tokens = packing.ChunkTokenizer(PATH)
    tokenizer, read, asked = tokens.tokenizer, [], []

    class Watched:
        def encode(self, text, **options):
            read.append(text)
            return tokenizer.encode(text, **options)

        def encode_batch_fast(self, some, **options):
            return tokenizer.encode_batch_fast(some, **options)

    monkeypatch.setattr(tokens, "tokenizer", Watched())
    monkeypatch.setattr(tokens.recent, "missing", lambda keys, missing=tokens.recent.missing: (asked.extend(keys), missing(keys))[1])
    for text, ids in zip(texts, tokens(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert not read and asked.count("often") == 1
    made = json.loads(tokenizer.to_str())
    assert packing.byte_letters(made) is not None
    for part, change in (("pre_tokenizer", {"type": "Whitespace"}), ("normalizer", {"type": "NFKC"}), ("post_processor", {"type": "ByteLevel"})):
        assert packing.byte_letters(made | {part: change}) is None
    assert packing.byte_letters(made | {"normalizer": None}) is not None
