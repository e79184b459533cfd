"""Conversation repair by weighted finite-state composition.

Three machines are composed lazily: an acceptor of a conversation's rows (each a role initial and a fault), an edit
transducer (keep, rerole, delete, insert) and an acceptor of the role grammar ``(s?(ua)+)?``. States of the composition
are (rows read, inserts since the last row, grammar state); only those that can be reached are made, in topological
order, and each keeps the least weight, a pair of cost and edit letters compared in that order.

A row costs the same wherever it stands, so a stretch of rows composes to a small matrix: the least weight from each
grammar state to each. Rows are dealt by ranges of conversation and turn, so that a conversation of any size is spread
over tasks: those that lie within one task are settled there, the others (one at each border of two tasks, and any
longer than BLOCK rows) give a matrix for each block, and the matrices are multiplied. Letters of a prefix are compared
by rank there, not letter by letter: two prefixes that end with the same row are never prefixes of each other.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Grammar states: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: More inserts in a row lead to a state that fewer have reached at less cost.
MAX_INSERTS = 2
#: Rows, and characters of text, of one block.
BLOCK, BLOCK_CHARS = 512, 1 << 24
FINE, BLANK, DUPLICATE, CUT = "", "blank", "duplicate", "truncated"
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\f\r"

Weight = tuple[int, str]
COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def edits(initial: str, fault: str) -> list[tuple[str, str, int]]:
    """Arcs of the edit transducer that read a row: letter, role initial written ('' for none) and cost."""
    arcs = [("D", "", DELETE)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        # A row without a role writes none when kept, which is not what D's empty output means.
        arcs += [("K", initial, more)] * bool(initial) + [("R", o, REROLE + more) for o in NAMES]
    return arcs


def _relax(layer: dict[int, Weight], state: int, weight: Weight) -> None:
    if state not in layer or weight < layer[state]:
        layer[state] = weight


def inserted(layer: dict[int, Weight]) -> dict[int, Weight]:
    """``layer`` and what inserts reach from it, one layer of the composition for each insert."""
    best, now = dict(layer), layer
    for _ in range(MAX_INSERTS):
        after: dict[int, Weight] = {}
        for state, (cost, audit) in now.items():
            for role in NAMES:
                if role in GRAMMAR[state]:
                    _relax(after, GRAMMAR[state][role], (cost + INSERT, audit + "I"))
        for state, weight in after.items():
            _relax(best, state, weight)
        now = after
    return best


def compose(symbols: list[tuple[str, str]], start: int) -> dict[int, Weight]:
    """Least weight to each grammar state reached from ``start`` right after the last of the rows ``symbols``."""
    layer: dict[int, Weight] = {start: (0, "")}
    for initial, fault in symbols:
        after: dict[int, Weight] = {}
        for state, (cost, audit) in inserted(layer).items():
            for letter, role, price in edits(initial, fault):
                if not role:
                    _relax(after, state, (cost + price, audit + letter))
                elif role in GRAMMAR[state]:
                    _relax(after, GRAMMAR[state][role], (cost + price, audit + letter))
        layer = after
    return layer


def finish(layer: dict[int, Weight]) -> Weight:
    """The least weight in a final state, with inserts after the last row."""
    return min(w for s, w in inserted(layer).items() if s in FINAL)


def chain(blocks: list[list[dict[int, Weight]]]) -> tuple[int, list[str]]:
    """Least cost through the matrices of consecutive blocks, and the letters of each block; the last item holds the
    inserts after the last row."""
    layer: dict[int, tuple[int, int]] = {START: (0, 0)}  # cost, and rank of the letters so far
    back: list[dict[int, tuple[int, str]]] = []
    for block in blocks:
        after: dict[int, tuple[int, int, str, int]] = {}
        for state, (cost, rank) in layer.items():
            for to, (price, audit) in block[state].items():
                found = (cost + price, rank, audit, state)
                if to not in after or found < after[to]:
                    after[to] = found
        order = {to: k for k, to in enumerate(sorted(after, key=lambda to: after[to][1:3]))}
        layer = {to: (w[0], order[to]) for to, w in after.items()}
        back.append({to: (w[3], w[2]) for to, w in after.items()})
    ends = [(cost + price, rank, audit, state) for state, (cost, rank) in layer.items() for to, (price, audit) in inserted({state: (0, "")}).items() if to in FINAL]
    cost, _, tail, state = min(ends)
    pieces = [tail]
    for step in reversed(back):
        state, audit = step[state]
        pieces.append(audit)
    return cost, pieces[::-1]


def repaired(rows: list[tuple[str, str]], audit: str, state: int = START) -> tuple[list[tuple[str, str, str]], int]:
    """(letter, role, text) of each row that the edits ``audit`` leave or make of ``rows``, and the grammar state after them."""
    out, source = [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(source)
        if letter == "D":
            continue
        if letter != "K":
            role = NAMES["a" if state == USER else "u"]
        state = GRAMMAR[state][role[:1]]
        out.append((letter, role, text))
    return out, state


@dataclass
class Stretch:
    """Consecutive rows of one conversation, and what is counted of them."""

    rows: list[tuple[str, str]] = field(default_factory=list)
    symbols: list[tuple[str, str]] = field(default_factory=list)
    turns: list[int] = field(default_factory=list)
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        self.rows.append((role, text if fault in (FINE, CUT) else ""))
        self.symbols.append((role[:1], fault))
        self.chars += len(text)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def counts(self) -> dict:
        faults, initials = [f for _, f in self.symbols], [i for i, _ in self.symbols]
        return {
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
            "ends": initials[:1] + initials[-1:], "turns": [self.turns[0], self.turns[-1], len(self.turns)] if self.turns else None,
        }


def joined(parts: list[dict]) -> tuple[int, int, int, int, int]:
    """gaps, blank, duplicate, truncated and illegal of a conversation from the counts of its blocks in order."""
    blank, duplicate, truncated, illegal = (sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal"))
    ends = [p["ends"] for p in parts if p["ends"]]
    illegal += sum(a[-1] + b[0] not in LEGAL for a, b in zip(ends, ends[1:], strict=False))
    turns = [p["turns"] for p in parts if p["turns"]]
    gaps = 0
    if turns:
        distinct = sum(n for _, _, n in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:], strict=False))
        gaps = turns[-1][1] - turns[0][0] + 1 - distinct
    return gaps, blank, duplicate, truncated, illegal


def _narrow(rows: DataFrame) -> DataFrame:
    return rows.where("copies > 0 AND fault <> 'blank'").select("conv", "turn", "role", "digest").distinct()


def _marks(rows: DataFrame) -> DataFrame:
    """conv, turn, role, digest wherever the same role and text stand at an earlier turn of the conversation."""
    each = _narrow(rows)
    keys = F.coalesce(F.col("conv").cast("string"), F.lit("")), F.col("role"), F.col("digest")
    same = F.md5(F.concat(F.col("conv").isNull().cast("string"), *(F.concat(F.lit(":"), F.length(k).cast("string"), F.lit(":"), k) for k in keys)))
    each = each.withColumn("same", same)
    first = each.groupBy("same").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return each.join(first, "same").where(~F.col("turn").eqNullSafe(F.col("first.turn"))).select("conv", "turn", "role", "digest")


def _dealt(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies: Column) -> DataFrame:
    """Rows in the order of conversation, turn, role and text; a mark goes before rows that repeat an earlier turn."""
    text = F.coalesce(F.col(text_col), F.lit(" "))
    bare = F.rtrim(text, F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.md5(text.cast("binary")).alias("digest"), fault.alias("fault"), copies.cast("int").alias("copies"), text.alias("text"),
    )
    marks = _marks(rows).withColumns({"fault": F.lit("mark"), "copies": F.lit(0), "text": F.lit("")})
    order = ["conv", "turn", "role", "digest"]
    return rows.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, F.desc(F.col("fault") == "mark"))


def _stream(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            yield from zip(*(some.column(c).to_pylist() for c in columns), strict=True)


def _settle(turns: DataFrame, kind: str, lines: bool) -> DataFrame:
    """What tasks can settle alone, and what is left open, as rows of one shape.

    step 0: a result (the columns of COUNTS and ``hash``; if ``lines``, instead one row for each repaired row, ``place``
    counting them and ``audit`` holding its letter). step 1: an open block (``audit`` holds its counts and matrix as
    JSON). step 2: a row of an open block. ``part``, ``block`` and ``place`` order open rows.
    """
    schema = f"step int, conv {kind}, {COUNTS}, hash string, part int, block bigint, place bigint, role string, text string"
    out = common.pa_schema(turns.sparkSession, schema)
    columns = ["conv", "turn", "role", "digest", "fault", "copies", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ready: list[dict] = []

        def block_rows(conv, stretch: Stretch, block: int) -> Iterator[dict]:
            matrix = [{str(to): w for to, w in compose(stretch.symbols, s).items()} for s in range(4)]
            yield {"step": 1, "conv": conv, "part": part, "block": block, "audit": json.dumps(stretch.counts() | {"matrix": matrix})}
            for place, (role, text) in enumerate(stretch.rows):
                yield {"step": 2, "conv": conv, "part": part, "block": block, "place": place, "role": role, "text": text}

        def closed(conv, stretch: Stretch) -> Iterator[dict]:
            cost, audit = finish(compose(stretch.symbols, START))
            kept, _ = repaired(stretch.rows, audit)
            if lines:
                yield from ({"step": 0, "conv": conv, "place": i, "audit": letter, "role": r, "text": t} for i, (letter, r, t) in enumerate(kept))
                return
            names = ("gaps", "blank", "duplicate", "truncated", "illegal")
            digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in kept).encode("utf-8", "replace")).hexdigest()
            yield {"step": 0, "conv": conv, "cost": cost, "audit": audit, "hash": digest} | dict(zip(names, joined([stretch.counts()]), strict=True))

        def work() -> Iterator[dict]:
            conv, stretch, block, first = None, None, 0, True
            marked = seen = None
            for now, turn, role, digest, fault, copies, text in _stream(batches, columns):
                if stretch is not None and now != conv:
                    # The first conversation may have begun in the task before.
                    yield from (block_rows(conv, stretch, block) if first or block else closed(conv, stretch))
                    stretch, first = None, False
                if stretch is None:
                    conv, stretch, block, marked, seen = now, Stretch(), 0, None, None
                key = (turn, role, digest)
                if fault == "mark":
                    marked = key
                for _ in range(copies):
                    stretch.add(turn, role, text, fault if fault == BLANK else DUPLICATE if key in (marked, seen) else fault)
                    seen = key
                    if len(stretch.rows) >= BLOCK or stretch.chars >= BLOCK_CHARS:
                        yield from block_rows(conv, stretch, block)
                        stretch, block = Stretch(), block + 1
            if stretch is not None:  # the last one may go on in the next task
                yield from block_rows(conv, stretch, block)

        size = 0
        for row in work():
            ready.append(row)
            size += len(row.get("text") or "") + len(row.get("audit") or "")
            if len(ready) >= 1024 or size >= BLOCK_CHARS:
                yield pa.RecordBatch.from_pylist(ready, schema=out)
                ready, size = [], 0
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=out)

    return turns.mapInArrow(run, schema)


def _groups(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of rows that begin with a conversation, (True, conversation, None) at its end and (False, conversation, row) before."""
    last, any_row = None, False
    for row in rows:
        if any_row and row[0] != last:
            yield True, last, None
        last, any_row = row[0], True
        yield False, last, row
    if any_row:
        yield True, last, None


def _pieces(blocks: DataFrame, kind: str) -> DataFrame:
    """From the matrices of open conversations: the letters of each block (step 3, with the grammar state before it as
    ``cost``) and, after the last block, the conversation's counts and the inserts at its end (step 4)."""
    schema = f"step int, conv {kind}, {COUNTS}, part int, block bigint, place bigint, role string, text string"
    out = common.pa_schema(blocks.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, dict]] = []
        for ended, conv, row in _groups(_stream(batches, ["conv", "part", "block", "audit"])):
            if not ended:
                found = json.loads(row[3])
                found["matrix"] = [{int(to): tuple(w) for to, w in m.items()} for m in found["matrix"]]
                held.append((row[1], row[2], found))
                continue
            cost, pieces = chain([h[2]["matrix"] for h in held])
            gaps, blank, duplicate, truncated, illegal = joined([h[2] for h in held])
            rows = [{"step": 3, "conv": conv, "part": p, "block": b, "place": -1, "audit": a} for (p, b, _), a in zip(held, pieces, strict=False)]
            last = {"step": 4, "conv": conv, "part": (1 << 31) - 1, "block": 0, "place": -1, "cost": cost, "audit": "".join(pieces), "role": pieces[-1]}
            rows.append(last | {"gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal})
            for at in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_pylist(rows[at : at + 1024], schema=out)
            held = []

    return blocks.repartition("conv").sortWithinPartitions("conv", "part", "block").mapInArrow(run, schema)


def _finished(rows: DataFrame, kind: str, lines: bool) -> DataFrame:
    """Results of the open conversations, as step 0 of ``_settle``: the letters of each block, then its rows, one by one."""
    schema = f"conv {kind}, {COUNTS}, hash string, place bigint, role string, text string"
    out = common.pa_schema(rows.sparkSession, schema)
    columns = ["conv", "step", "audit", "role", "text", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work() -> Iterator[dict]:
            state, digest, place, letters, at = START, hashlib.sha256(), 0, "", 0

            def emit(row: tuple[str, str] | None) -> Iterator[dict]:
                """Inserts before ``row`` and the row itself, or with None the inserts at the end."""
                nonlocal state, place, at
                end = at
                while end < len(letters) and letters[end] == "I":
                    end += 1
                end += row is not None
                kept, state = repaired([row] if row is not None else [], letters[at:end], state)
                at = end
                for letter, role, text in kept:
                    digest.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "replace"))
                    if lines:
                        yield {"conv": conv, "place": place, "audit": letter, "role": role, "text": text}
                    place += 1

            for ended, conv, row in _groups(_stream(batches, columns)):
                if ended:
                    state, digest, place = START, hashlib.sha256(), 0
                    continue
                _, step, audit, role, text, *counts = row
                if step == 3:
                    letters, at = audit, 0
                elif step == 2:
                    yield from emit((role, text))
                else:
                    letters, at = role, 0
                    yield from emit(None)
                    if not lines:
                        names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
                        yield {"conv": conv, "audit": audit, "hash": digest.hexdigest()} | dict(zip(names, counts, strict=True))

        ready: list[dict] = []
        size = 0
        for row in work():
            ready.append(row)
            size += len(row.get("text") or "") + len(row.get("audit") or "")
            if len(ready) >= 1024 or size >= BLOCK_CHARS:
                yield pa.RecordBatch.from_pylist(ready, schema=out)
                ready, size = [], 0
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=out)

    return rows.repartition("conv").sortWithinPartitions("conv", "part", "block", "place").mapInArrow(run, schema)


def _repair(turns: DataFrame, cols: tuple[str, str, str, str], copies: Column, lines: bool) -> DataFrame:
    kind = dict(turns.dtypes)[cols[0]]
    settled = common.materialize(_settle(_dealt(turns, *cols, copies), kind, lines), "conversations")
    keep = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "hash", "place", "role", "text"]
    pieces = _pieces(settled.where("step = 1"), kind)
    left = settled.where("step = 2").drop("hash").unionByName(pieces)
    return settled.where("step = 0").select(*keep).unionByName(_finished(left, kind, lines).select(*keep))


def audit_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> DataFrame:
    """One row for each conversation: ``conv_col``, gaps, blank, duplicate, truncated, illegal, cost, audit (the letters of
    the cheapest edits, K R D I) and repaired_sha256.

    Rows go by turn (null turns first), then role, then the MD5 of the text. Null roles and texts are one space, so a null
    text is blank; a null conversation is one of its own. Roles other than system, user and assistant by their initial fit
    nowhere and are changed or deleted. Equal rows are duplicates of the first, also in the same turn. ``copies`` says how
    often each row stands (1 if not given); a conversation of which no row stands has zeros, an empty audit and the hash of
    nothing. An empty table gives no rows. Very long texts are read whole. A conversation of any length is composed
    block by block in many tasks; only its hash, which is sequential, reads the rows of one that spans tasks in one
    task, one after the other. Equal rows of one conversation and turn are read in one task as well. Other columns are not looked at.
    """
    found = _repair(turns, (conv_col, turn_col, role_col, text_col), F.lit(1) if copies is None else copies, False)
    return found.select(F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("hash").alias("repaired_sha256"))


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> DataFrame:
    """The repaired rows: ``conv_col``, place (from 0), edit (K, R or I), ``role_col``, ``text_col``. Cases as in
    ``audit_conversations``; conversations of which nothing is left have no rows."""
    found = _repair(turns, (conv_col, turn_col, role_col, text_col), F.lit(1) if copies is None else copies, True)
    return found.select(F.col("conv").alias(conv_col), "place", F.col("audit").alias("edit"), F.col("role").alias(role_col), F.col("text").alias(text_col))


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with known damage, and ``copies``: by CRC-32 of ``conversation:turn`` mod 20, a row is dropped (0), emptied
    (1), stripped of ``.!?`` (2), doubled (3) or given to the user (4)."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)]
    case = F.crc32(F.concat(names[0], F.lit(":"), names[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    return turns.select(
        conv_col, turn_col, F.when(case == 4, F.lit("user")).otherwise(role).alias(role_col),
        F.when(case <= 1, F.lit("")).when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias(text_col),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"),
    )


def op11_conversations(spark, sf_dir: str) -> DataFrame:
    return audit_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), copies=F.col("copies"))
