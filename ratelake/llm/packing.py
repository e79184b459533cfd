"""Packing documents into training sequences: shortest-pack-first over the histogram of lengths.

Every document becomes full sequences plus one remainder shorter than ``max_len``. Only the histogram of
remainders (at most ``max_len`` - 1 counts, however many documents there are) goes to the driver. There,
lengths are placed longest first, each into the pattern with the most room left, and only counts of patterns
change. Documents then find their place by rank within their length. The emptiest patterns are taken apart
again and their documents cut to fill the room that the others leave, so that no token of padding remains.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import json
import os
import string
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MAX_LEN = 2048
END_ID = 1
#: Chunks of text whose ids a worker remembers at most (some 150 bytes each, kept as long as the worker lives).
CACHE = 600_000
#: The pre-tokens of a tokenizer that leaves a word of letters whole (``byte_letters``).
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class ChunkTokenizer:
    """Token ids of whole texts as little-endian 32-bit bytes, with the ids of space-free chunks remembered.

    Pre-tokens never cross a space or newline, so the ids of a text are the ids of its chunks, joined.
    A chunk of letters and one closing mark is the ids of the letters, then those of the mark. Case is folded
    before the look-up where that is the tokenizer's own folding, character by character.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.folds = '"Lowercase"' in json.dumps(made["normalizer"])
        suffix = made["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.bytes_of = byte_letters(made)
        self.model = self.tokenizer.model
        self.recent = common.Recent(CACHE)

    def _look_up(self, chunks: list[str]) -> None:
        for c, e in zip(chunks, self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False), strict=True):
            self.recent.known[c] = array("I", e.ids).tobytes()

    def _look_up_words(self, words: list[str]) -> None:
        """Lower-case words of one-byte letters go to the model itself, which is all that is left to do with them; of others, many in one
        text each time, and the ids with an end-of-word mark tell them apart."""
        if self.bytes_of is not None:
            rest, known, letters = [], self.recent.known, self.model.tokenize
            for w in words:
                if not w.islower() or not is_latin(w):
                    rest.append(w)
                    continue
                made = letters(w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes_of))
                known[w] = array("I", [t.id for t in made]).tobytes()
            words = rest
        for at in range(0, len(words), 64):
            some = words[at : at + 64]
            ids = array("I", self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids)
            cuts = (np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)]) + 1).tolist()
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                self._look_up(some)
                continue
            raw, a = ids.tobytes(), 0
            for w, b in zip(some, cuts, strict=True):
                self.recent.known[w] = raw[a * 4 : b * 4]
                a = b

    def _learn(self, chunks: set[str]) -> None:
        known, split, words, rest = self.recent.known, [], set(), set()
        for c in chunks:
            stem = c.rstrip(string.punctuation)
            if stem.isalpha():
                words.add(stem)
                if len(stem) < len(c):
                    split.append((c, stem, c[len(stem) :]))
                    rest.add(c[len(stem) :])
            else:
                rest.add(c)
        self._look_up_words([w for w in words if w not in known])
        self._look_up([c for c in rest if c not in known])
        for c, stem, marks in split:
            known[c] = known[stem] + known[marks]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 64):
            met, missed = [], set()
            known = self.recent.known
            for text in texts[at : at + 64]:
                if self.folds and "<|" not in text and is_latin(text):
                    text = text.lower()
                chunks = text.replace("\n", " ").split(" ")
                ids = list(map(known.get, chunks))
                gaps = [i for i, found in enumerate(ids) if found is None]
                missed.update([chunks[i] for i in gaps])
                met.append((chunks, ids, gaps))
            if missed:
                # What the texts hold stays in the younger generation when a new one begins.
                begins = self.recent.full(len(missed))
                new = self.recent.missing(missed.union(*(chunks for chunks, *_ in met)) if begins else missed)
                if new:
                    self._learn(new)
            known = self.recent.known
            for chunks, ids, gaps in met:
                for i in gaps:
                    ids[i] = known[chunks[i]]
                yield b"".join(ids)


def byte_letters(made: dict) -> dict[int, str] | None:
    """What stands for each byte (as a Latin-1 character) before the model of the tokenizer ``made`` (its JSON), where all that the tokenizer
    does with a lower-case, composed word of letters is to write its bytes so and hand it over in one piece; else None."""
    normal, parts = made["normalizer"] or {"normalizers": []}, made["pre_tokenizer"] or {}
    steps = [s["type"] for s in normal.get("normalizers", [normal]) if s != {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}]
    cuts = parts.get("pretokenizers", [])
    if not set(steps) <= {"NFC", "Lowercase"} or len(cuts) != 2 or made["post_processor"] or made["truncation"] or made["padding"]:
        return None
    split, last = cuts
    if (split["type"], split.get("behavior"), split.get("invert"), split.get("pattern")) != ("Split", "Removed", True, {"Regex": LETTERS}):
        return None
    if last["type"] != "ByteLevel" or last["add_prefix_space"] or last["use_regex"] or any(t["content"].isalpha() for t in made["added_tokens"]):
        return None
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printed]
    return {b: chr(256 + i) for i, b in enumerate(others)}


def is_latin(text: str) -> bool:
    """Only characters up to U+00FF, which lower-case one by one and are composed already."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@functools.cache
def tokenizer(path: str) -> ChunkTokenizer:
    """One a worker process, so that tasks that follow each other share what it remembers."""
    return ChunkTokenizer(path)


@dataclass
class Plan:
    """Where the documents of each remainder length go, as runs of ranks. Its size depends on ``max_len`` alone.

    placed[length]: (first rank, last rank + 1, first sequence, copies a sequence, first offset), by first rank.
    donors[length]: (first rank, last rank + 1, first token in the stream of cut documents), by first rank.
    slots: (first token, last token + 1, room, first sequence, offset) of what the stream fills, by first token.
    """

    placed: dict[int, list[tuple[int, int, int, int, int]]] = field(default_factory=dict)
    donors: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    slots: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    padding: int = 0


def histogram_packs(histogram: dict[int, int], max_len: int) -> list[tuple[int, tuple[tuple[int, int], ...], int]]:
    """Shortest-pack-first: (room left, ((length, copies), ...), number of packs), for a histogram of lengths."""
    room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    open_rooms: list[int] = []

    def put(left: int, parts: tuple[tuple[int, int], ...], count: int) -> None:
        if left not in room:
            room[left] = []
            heapq.heappush(open_rooms, -left)
        room[left].append((parts, count))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        todo = histogram[length]
        while todo:
            while open_rooms and -open_rooms[0] not in room:
                heapq.heappop(open_rooms)
            left = -open_rooms[0] if open_rooms else 0
            if left < length:
                put(max_len - length, ((length, 1),), todo)
                break
            parts, count = room[left].pop()
            if not room[left]:
                del room[left]
            fits = min(left // length, -(-todo // count)) if todo > count else 1
            n = min(count, todo // fits)
            if n < count:
                put(left, parts, count - n)
            put(left - fits * length, (*parts, (length, fits)), n)
            todo -= n * fits
    return [(left, parts, count) for left, packs in sorted(room.items()) for parts, count in packs]


def plan_packs(histogram: dict[int, int], max_len: int = MAX_LEN) -> Plan:
    """Number the packs, take the emptiest apart, and lay the stream of their documents over the room left."""
    packs = histogram_packs(histogram, max_len)
    plan, next_rank = Plan(), dict.fromkeys(histogram, 0)
    gaps = sum(left * n for left, _, n in packs)
    donors: list[tuple[tuple[tuple[int, int], ...], int]] = []
    free = 0
    while packs and free < gaps:
        left, parts, n = packs.pop()
        # Each pack taken apart closes its own gap and gives its tokens.
        take = min(n, -(-(gaps - free) // max_len))
        donors.append((parts, take))
        gaps -= left * take
        free += (max_len - left) * take
        if take < n:
            packs.append((left, parts, n - take))
    stream = 0
    for parts, n in donors:
        for length, copies in parts:
            first = next_rank[length]
            next_rank[length] = last = first + n * copies
            plan.donors.setdefault(length, []).append((first, last, stream))
            stream += length * n * copies
    at = 0

    def slot(room: int, n: int, sequence: int, offset: int) -> None:
        nonlocal at
        n = min(n, (stream - at) // room) if room else 0
        if n:
            plan.slots.append((at, at + n * room, room, sequence, offset))
            at += n * room

    for left, parts, n in packs:
        offset = 0
        for length, copies in parts:
            first = next_rank[length]
            next_rank[length] = last = first + n * copies
            plan.placed.setdefault(length, []).append((first, last, plan.sequences, copies, offset))
            offset += length * copies
        slot(left, n, plan.sequences, offset)
        plan.sequences += n
    whole = (stream - at) // max_len
    slot(max_len, whole, plan.sequences, 0)
    plan.sequences += whole
    rest = max_len
    while at < stream:  # what is left is less than a sequence: sequences of powers of two need no padding
        while rest > stream - at:
            rest //= 2
        slot(rest, 1, plan.sequences, 0)
        plan.sequences += 1
    for runs in (*plan.placed.values(), *plan.donors.values()):
        runs.sort()
    plan.padding = sum(left * n for left, _, n in packs) - sum(b - a for a, b, room, _, o in plan.slots if o)
    return plan


def place(plan: Plan, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """(start in the remainder, length, sequence, offset) of the pieces of the document of that length and rank."""
    runs = plan.placed.get(length, [])
    i = bisect.bisect_right(runs, (rank, 1 << 62)) - 1
    if i >= 0 and rank < runs[i][1]:
        first, _, sequence, copies, offset = runs[i]
        return [(0, length, sequence + (rank - first) // copies, offset + (rank - first) % copies * length)]
    cuts = plan.donors[length]
    first, _, stream = cuts[bisect.bisect_right(cuts, (rank, 1 << 62, 0)) - 1]
    at = begin = stream + (rank - first) * length
    out = []
    i = bisect.bisect_right(plan.slots, (at, 1 << 62)) - 1
    while at < begin + length:
        lo, hi, room, sequence, offset = plan.slots[i]
        if at >= hi:
            i += 1
            continue
        k, used = divmod(at - lo, room)
        n = min(room - used, begin + length - at)
        out.append((at - begin, n, sequence + k, offset + used))
        at += n
    return out


TOKENS = "id bigint, row bigint, part bigint, doc_tokens bigint, rest int, local bigint, full array<bigint>, sequence bigint, crc bigint, ids binary"


def tokenized(docs: DataFrame, tokenizer_path: str, max_len: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: token count, CRCs of its full sequences, the ids of its remainder, its rank in this task."""
    schema = common.pa_schema(docs.sparkSession, TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(tokenizer_path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(max_len, np.int64)
        row = sequence = 0
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512).to_pydict()
                out: dict[str, list] = {f.name: [] for f in schema}
                for doc, ids in zip(some["id"], tokens([t or "" for t in some["text"]]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    cut = n // max_len
                    rest = ids[cut * max_len * 4 :]
                    r = len(rest) // 4
                    out["id"].append(doc)
                    out["row"].append(part << 40 | row)
                    out["part"].append(part)
                    out["doc_tokens"].append(n)
                    out["rest"].append(r)
                    out["local"].append(int(seen[r]))
                    out["full"].append([zlib.crc32(ids[k * max_len * 4 : (k + 1) * max_len * 4]) for k in range(cut)])
                    out["sequence"].append((part << 40 | sequence) * 2 + 1)
                    out["crc"].append(zlib.crc32(rest))
                    out["ids"].append(np.frombuffer(rest, "<u4").astype("<u2" if tokens.tokenizer.get_vocab_size() <= 65536 else "<u4").tobytes())
                    seen[r] += 1
                    row += 1
                    sequence += cut
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, TOKENS)


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents with their sequence and offset; every token id lies in exactly one piece.

    Null and empty texts are the closing id alone; null ids and repeated rows are documents of their own; an
    empty table gives no rows. Sequences with odd numbers hold one full piece; the others are the packs, plus
    at most log2(max_len) short ones whose sizes are powers of two. Columns: ``id_col``, start, length,
    ids_crc32, doc_tokens, sequence_id, offset. Shuffles the histogram and the ranks; texts are read once.
    """
    spark = docs.sparkSession
    rows = common.materialize(tokenized(docs, tokenizer_path, max_len, id_col, text_col), "packing")
    counts = rows.where("rest > 0").groupBy("rest", "part").agg(F.count("*").alias("n"))
    histogram = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packs(histogram, max_len)
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("rest", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    full = rows.where("size(full) > 0").select(
        "id", "doc_tokens", "sequence", F.posexplode("full").alias("k", "ids_crc32")
    ).select(
        F.col("id").alias(id_col), (F.col("k").cast("bigint") * max_len).alias("start"), F.lit(max_len).cast("bigint").alias("length"),
        "ids_crc32", "doc_tokens", (F.col("sequence") + 2 * F.col("k")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )

    ranked = rows.where("rest > 0").select("id", "row", "part", "doc_tokens", "rest", "local", "crc").join(bases, ["rest", "part"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("local"))
    whole_plan = spark.sparkContext.broadcast(plan)
    pieces = "id bigint, row bigint, doc_tokens bigint, rest int, crc bigint, start bigint, length bigint, sequence_id bigint, offset bigint"

    def find(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("id", "row", "doc_tokens", "rest", "crc", "start", "length", "sequence_id", "offset")}
        for doc, row, n, rest, crc, rank in zip(*(batch[k] for k in ("id", "row", "doc_tokens", "rest", "crc", "rank")), strict=True):
            for start, length, sequence, offset in place(whole_plan.value, rest, rank):
                for k, v in zip(out, (doc, row, n, rest, crc, n - rest + start, length, 2 * sequence, offset), strict=True):
                    out[k].append(v)
        return out

    found = common.map_arrow(ranked.select("id", "row", "doc_tokens", "rest", "crc", "rank"), find, pieces, 8192)
    found = common.materialize(found, "pieces")
    whole = found.where("length = rest").select(
        F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
    lengths = sorted(plan.donors)
    wide = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def digest(batch: dict[str, list]) -> dict[str, list]:
        crcs = []
        for ids, rest, n, start, length in zip(*(batch[k] for k in ("ids", "rest", "doc_tokens", "start", "length")), strict=True):
            lo = start - (n - rest)
            some = np.frombuffer(ids, "<u2" if len(ids) == 2 * rest else "<u4")[lo : lo + length]
            crcs.append(zlib.crc32(some.astype("<u4").tobytes()))
        return {k: batch[k] for k in ("id", "start", "length")} | {"ids_crc32": crcs} | {k: batch[k] for k in ("doc_tokens", "sequence_id", "offset")}

    cut = found.where("length < rest").join(rows.where(F.col("rest").isin(lengths)).select("row", "ids"), "row")
    cut = common.map_arrow(cut.select("id", "ids", "rest", "doc_tokens", "start", "length", "sequence_id", "offset"), digest, wide)
    return full.unionByName(whole).unionByName(cut.withColumnRenamed("id", id_col))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
