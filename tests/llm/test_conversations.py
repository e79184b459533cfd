import hashlib
import itertools
import random

import pytest

from ratelake.llm import conversations as cv

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, copies int"


def legal(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return not initials or len(rest) >= 2 and len(rest) % 2 == 0 and set(rest[::2]) <= {"u"} and set(rest[1::2]) <= {"a"}


def cheapest(symbols):
    """Least (cost, letters) over all edits with at most three inserts at each place, without any machine."""
    best = None
    n = len(symbols)
    choices = [[("D", "", 4)] if f in (cv.BLANK, cv.DUPLICATE) else [("D", "", 4), ("K", i, 3 * (f == cv.CUT)), ("R", "u", 3 + 3 * (f == cv.CUT)), ("R", "a", 3 + 3 * (f == cv.CUT))] for i, f in symbols]
    fills = ["", *("".join(p) for k in (1, 2, 3) for p in itertools.product("ua", repeat=k))]
    for picks in itertools.product(*choices):
        for gaps in itertools.product(fills, repeat=n + 1):
            out = gaps[0] + "".join(p[1] + g for p, g in zip(picks, gaps[1:], strict=True))
            if legal(out):
                audit = "I" * len(gaps[0]) + "".join(p[0] + "I" * len(g) for p, g in zip(picks, gaps[1:], strict=True))
                found = (sum(p[2] for p in picks) + 3 * sum(map(len, gaps)), audit)
                best = found if best is None or found < best else best
    return best


def test_machine_equals_all_edits():
    faults = [cv.FINE, cv.BLANK, cv.DUPLICATE, cv.CUT]
    for n in (0, 1):
        for symbols in itertools.product(itertools.product("suax", faults), repeat=n):
            assert cv.finish(cv.compose(list(symbols), cv.START)) == cheapest(symbols)
    rng = random.Random(4)
    for _ in range(25):
        symbols = [(rng.choice("suua x"), rng.choice(faults)) for _ in range(2)]
        assert cv.finish(cv.compose(symbols, cv.START)) == cheapest(symbols)


def test_blocks_give_the_same_as_one_stretch():
    rng = random.Random(9)
    for _ in range(300):
        symbols = [(rng.choice("suuuaaax"), rng.choice([cv.FINE] * 5 + [cv.BLANK, cv.DUPLICATE, cv.CUT])) for _ in range(rng.randint(0, 14))]
        whole = cv.finish(cv.compose(symbols, cv.START))
        cuts = sorted(rng.randint(0, len(symbols)) for _ in range(rng.randint(0, 4)))
        parts = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True)]
        cost, pieces = cv.chain([[cv.compose(p, s) for s in range(4)] for p in parts])
        assert (cost, "".join(pieces)) == whole


def plain(rows):
    """Every output column of audit_conversations by plain loops; rows: (conv, turn, role, text) with copies spelt out."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv and t != "gone"]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        symbols, seen = [], set()
        for _, role, text in own:
            bare = text.strip(cv.SPACE)
            fault = cv.BLANK if not bare else cv.DUPLICATE if (role, text) in seen else cv.FINE if bare[-1] in ".!?" else cv.CUT
            symbols.append((role[:1], fault))
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        cost, audit = cv.finish(cv.compose(symbols, cv.START))
        lines, it, last = [], iter(own), ""
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(it)[1:]
            if letter == "D":
                continue
            role = role if letter == "K" else "assistant" if last == "u" else "user"
            lines.append(f"{role}:{text}")
            last = role[0]
        kinds = [f for _, f in symbols]
        illegal = sum(a[0] + b[0] not in cv.LEGAL for a, b in zip(symbols, symbols[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, kinds.count(cv.BLANK), kinds.count(cv.DUPLICATE), kinds.count(cv.CUT), illegal, cost, audit, digest)
    return out


def many(seed, convs=25, longest=40):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(convs)]:
        for _ in range(rng.randint(1, longest)):
            turn = rng.choice([None, *range(12)])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["Hi there.", "so", "what?\n ", " \t", "", None, "Ünder!", "x" * 50])))
    return rows


@pytest.mark.parametrize("block", [512, 3])
@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_plain_loops(spark, monkeypatch, block, partitions):
    monkeypatch.setattr(cv, "BLOCK", block)
    rows = many(block + partitions)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame([(*r, "other", 1) for r in rows], SCHEMA)
        got = {r[0]: tuple(r[1:]) for r in cv.audit_conversations(table).collect()}
        assert got == plain(rows)
        fixed = {}
        for r in cv.repair_conversations(table).orderBy("conv_id", "place").collect():
            fixed.setdefault(r["conv_id"], []).append(r)
        for conv, own in fixed.items():
            assert [r["place"] for r in own] == list(range(len(own))) and legal("".join(r["role"][:1] for r in own))
            assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest() == got[conv][-1]
        assert all(conv in fixed or set(v[6]) <= {"D"} for conv, v in got.items())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_conversation_is_split_over_tasks(spark):
    """One conversation that holds most rows goes through many blocks and tasks, one very long text among its rows."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"line {t}." if t != 700 else "w " * 400_000 + ".") for t in range(2000)] + [(2, 0, "user", "a.")]
    got = {r[0]: r for r in cv.audit_conversations(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)).collect()}
    assert got[1]["cost"] == 0 and got[1]["audit"] == "K" * 2000 and got[1]["gaps"] == 0
    assert got[1]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{x}" for c, _, r, x in rows if c == 1).encode()).hexdigest()
    assert got[2]["cost"] == 3 and got[2]["audit"] == "KI"


def test_rows_that_do_not_stand(spark):
    table = spark.createDataFrame([(7, 0, "user", "a.", "", 0), (8, None, "assistant", "b", "", 2)], SCHEMA)
    got = {r[0]: tuple(r[1:]) for r in cv.audit_conversations(table, copies=table["copies"]).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[7] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[8] == (0, 0, 1, 1, 1, 8, "DD", empty)
    assert cv.audit_conversations(table.limit(0)).collect() == []
