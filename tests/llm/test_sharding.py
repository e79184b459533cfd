import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from ratelake.llm import sharding

SCHEMA = "doc_id bigint, text string, source string, size string, place int, n int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "other", 0, 0) for r in rows], SCHEMA)


def brute(rows, shards, seed):
    """(id, text, shard, slot) by sorting everything in one place."""

    def h(x):
        return hashlib.md5(f"{seed}:{x}".encode()).hexdigest()

    strata = defaultdict(list)
    for i, t, s in rows:
        strata[s].append((h(t or ""), h("" if i is None else i), i is not None, i or 0, t, i))
    order = []
    for s, own in strata.items():
        own.sort(key=lambda r: r[:4])
        order += [((k + 0.5) / len(own), s is not None, s or "", k, r[-1], r[-2]) for k, r in enumerate(own)]
    order.sort(key=lambda r: r[:4])
    n = len(order)
    out, slots = [], Counter()
    for at, r in enumerate(order):
        shard = at * shards // n
        out.append((r[4], r[5] or "", shard, slots[shard]))
        slots[shard] += 1
    return out


def mixed_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice([None, "a", "b", "hot", "hot", "hot", f"rare{rng.randint(0, 9)}"])
        text = rng.choice([None, "", "the same text", f"text {rng.randint(0, n)}", "ü" * rng.randint(0, 30)])
        rows.append((rng.choice([i, i, i, None, 5]), text, source))
    return rows


@pytest.mark.parametrize("n", [1, 5, 700])
@pytest.mark.parametrize("shards", [8, 3])
def test_equals_one_sort(spark, n, shards):
    rows = mixed_rows(n, n)
    got = [(r["doc_id"], r["text_md5"], r["shard"], r["slot"]) for r in sharding.plan_shards(docs(spark, rows), shards).collect()]
    want = [(i, hashlib.md5(t.encode()).hexdigest(), s, k) for i, t, s, k in brute(rows, shards, sharding.SEED)]
    key = lambda r: (r[0] is not None, r)
    assert sorted(map(repr, sorted(got, key=lambda r: repr(key(r))))) == sorted(map(repr, sorted(want, key=lambda r: repr(key(r)))))


def test_every_shard_has_the_mixture_and_copies_stay_close(spark):
    rows = [(i, f"text {i % 97 if i % 3 == 0 else i}", "hot" if i % 2 else f"s{i % 5}") for i in range(4000)]
    plan = {r["doc_id"]: r for r in sharding.plan_shards(docs(spark, rows)).collect()}
    counts = Counter(r["shard"] for r in plan.values())
    assert max(counts.values()) - min(counts.values()) <= 1
    for source, total in Counter(s for *_, s in rows).items():
        own = Counter(plan[i]["shard"] for i, _, s in rows if s == source)
        assert all(abs(own[k] - total / 8) <= 2 for k in range(8))
    for shard in range(8):
        assert sorted(r["slot"] for r in plan.values() if r["shard"] == shard) == list(range(counts[shard]))
    spread = [len({plan[i]["shard"] for i, t, _ in rows if t == f"text {k}"}) for k in range(97)]
    assert sum(x == 1 for x in spread) > 60 and max(spread) <= 2  # at most the shards on both sides of a cut


def test_sizes_and_digests(spark):
    rows = [(1, "ä b", "x"), (2, None, "x"), (3, "", None), (4, "z" * 3_000_000, "x")]
    got = {r["doc_id"]: r for r in sharding.plan_shards(docs(spark, rows)).collect()}
    assert {i: (r["size"], r["text_crc32"]) for i, r in got.items()} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    assert sharding.plan_shards(docs(spark, []).limit(0)).count() == 0


def test_written_shards_hold_all_rows_in_order(spark, tmp_path):
    rows = mixed_rows(200, 3) + [(9, "twice", "a"), (9, "twice", "b")]
    table = docs(spark, rows)
    plan = sharding.plan_shards(table)
    sharding.write_shards(table, plan, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.select(*table.columns).collect())) == sorted(map(repr, table.collect()))
    want = Counter((r["shard"], r["slot"]) for r in plan.collect())
    assert Counter((r["shard"], r["slot"]) for r in back.collect()) == want and set(want.values()) == {1}
    with pytest.raises(ValueError):
        sharding.write_shards(table.withColumnRenamed("n", "slot"), plan, str(tmp_path / "no"))


def test_no_python_in_the_plan(spark):
    plan = sharding.plan_shards(docs(spark, mixed_rows(20, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
