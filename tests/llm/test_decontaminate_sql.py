"""The SQL of op8 against the operator, on items with names, numbers in digits and words, and units."""

import duckdb
import pytest

from ratelake.llm import decontaminate, queries

ITEMS = [
    (1, "Tom has 5 apples. Tom buys 3 more apples. Tom then eats 2 of them. How many apples are left?"),
    (2, "a farmer has five apples and sells two of them at the market in the old town"),
    (3, "a train leaves the station and drives 120 kilometres before it stops at the next town"),
    (4, "In 1999 the city of Rome counted 2,500,000 people and in 1999 again as many"),
    (5, "3 4 5 6 7 8"), (6, "short one"), (7, None), (8, "a farmer has five apples and sells two of them at the market in the old town"), (None, "nameless item text here now"),
    (9, "the water was heated to twenty degrees and stayed there for three hours without any change"),
    (10, "McDonald met Anna Lee, Bob and Eve-Marie near Big Ben; then 7 Dwarfs sang"),
]
TEXTS = [
    "Anna has 9 apples. Anna buys 4 more apples. Anna then eats 7 of them. How many apples are left?",
    ITEMS[0][1], "Someone said:\nTom has 5 apples. Tom buys 3 more\tapples. Tom then eats 2 of them. How many apples are left? And so on.",
    "Anna has 9 apples. Bob buys 4 more apples. Anna then eats 7 of them. How many apples are left?",
    "we know that a farmer has nine apples and sells four of them at the market in the old town today", "a farmer has seven pears and buys two of them",
    "a train leaves the station and drives 200 miles before it stops at the next town", "a train leaves the station and drives 200miles before it stops at the next town",
    "In 2004 the city of Paris counted 1,500,000 people and in 2004 again as many", "In 2004 the city of Paris counted 1,500,000 people and in 2005 again as many",
    "count 3 4 5 6 7 8 now", "count 3 4 5 6 7 9 now", "a short one here", None, "", "nameless item text here now",
    "The water was heated to forty minutes and stayed there for six hours without any change", "the water was heated to 20 degrees and stayed there for 3 hours without any change",
    "McDonald met Eva Ray, Tim and Ann-Kate near Old Tom; then 9 Dwarfs sang", "# \u0001 \u0002 \u0003 marks",
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in decontaminate.contaminated(docs, bench).collect()}


def test_sql_equals_the_operator(found):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in enumerate(TEXTS)])
    c.executemany("INSERT INTO benchmark VALUES (?, ?)", [list(x) for x in ITEMS])
    want = {(r[0], r[1]): tuple(r[2:]) for r in c.execute(queries.ORACLE_SQL["op8_decontaminate"]).fetchall()}
    assert found == want


def test_other_numbers_names_and_units_are_found(found):
    kinds = {k: v[-1] for k, v in found.items()}
    assert kinds[0, 1] == "reparameterised" and kinds[1, 1] == kinds[2, 1] == "exact"
    assert kinds[4, 2] == kinds[6, 3] == kinds[7, 3] == kinds[8, 4] == kinds[16, 9] == "reparameterised"
    assert kinds[17, 9] == "reparameterised" and (5, 2) not in kinds and (4, 8) not in kinds
    assert kinds[10, 5] == "exact" and (11, 5) not in kinds and kinds[12, 6] == "exact"
