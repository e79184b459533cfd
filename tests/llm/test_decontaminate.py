import pytest

from ratelake.llm import decontaminate

ITEM = "A train leaves the station with Maria Lopez at 40 km per hour and reaches the river after 12 minutes of travel"
OTHER = "The shop sells 15 kg of apples to every guest who comes before noon on a quiet market day"


def found(spark, texts, items=((1, ITEM), (2, OTHER), (3, OTHER), (4, None), (5, ""), (6, "tiny item"))):
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id bigint, text string, item string")
    bench = spark.createDataFrame(list(items), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}


def test_exact_and_with_other_parameters(spark):
    again = ITEM.replace("40", "95").replace("12", "7").replace("Maria Lopez", "John Smith").replace("km", "miles")
    got = found(spark, [(10, f"Before it. {ITEM} and after."), (11, f"so {again} yes"), (12, "nothing of the kind is in here at all"), (13, None), (14, "")])
    assert set(got) == {(10, 1), (11, 1)}
    assert got[10, 1]["kind"] == "exact" and got[10, 1]["similarity"] >= 0.8
    assert got[11, 1]["kind"] == "reparameterised" and got[11, 1]["changed_slots"] > 0


def test_values_must_map_one_to_one(spark):
    item = (1, "take 5 red balls and put 5 red balls into 8 boxes then count 5 balls again slowly now")
    same = "take 7 red balls and put 7 red balls into 9 boxes then count 7 balls again slowly now"
    torn = "take 7 red balls and put 6 red balls into 9 boxes then count 4 balls again slowly now"
    assert set(found(spark, [(1, same), (2, torn)], [item])) == {(1, 1)}


def test_items_of_equal_text_and_short_items(spark):
    got = found(spark, [(1, OTHER), (2, "what a tiny item that is"), (None, OTHER)])
    assert set(got) == {(1, 2), (2, 6), (None, 2)}


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_both_joins_agree_and_filter_keeps_columns(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    monkeypatch.setattr(decontaminate, "BROADCAST_IDS", broadcast)
    docs = spark.createDataFrame([(1, f"x {ITEM} y", "a"), (2, "clean text", "b"), (None, "clean", "c"), (None, ITEM, "d")], "doc_id bigint, text string, r string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r["r"] for r in left.collect()) == ["b", "c"]
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0


def brute(texts, items, size=5):
    """Containment of plain word windows, for texts without numbers, names and units."""
    split = lambda t: "".join(c.lower() if c.isalpha() else " " for c in t).split()
    shingles = lambda w: {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    out = {}
    for d, t in texts:
        for i, b in items:
            want = shingles(split(b))
            share = len(want & shingles(split(t))) / len(want)
            if share >= 0.8:
                out[d, i] = round(share, 6)
    return out


def test_equals_brute_force_on_plain_words(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join("q" + word() for _ in range(rng.randint(8, 30)))) for i in range(12)]
    texts = []
    for d in range(60):
        body = ["q" + word() for _ in range(rng.randint(5, 60))]
        if d % 2:
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 2)):
                passage[rng.randrange(len(passage))] = "qzz"
            at = rng.randrange(len(body))
            body[at:at] = passage
        texts.append((d, " ".join(body)))
    got = {k: r["similarity"] for k, r in found(spark, texts, items).items()}
    assert got == brute(texts, items)


TOM = "Tom has 5 apples. Tom buys 3 more apples. Tom then eats 2 of them. How many apples are left?"


def test_names_at_sentence_starts_and_line_heads(spark):
    anna = TOM.replace("Tom", "Anna").replace("5", "9").replace("3", "4")
    torn = "Anna has 9 apples. Eve buys 4 more apples. Paul then eats 2 of them. How many apples are left?"
    texts = [(1, anna), (2, f'He said: "{anna}"'), (3, anna.replace("Anna", "Anna Lee")), (4, f"List:\n({TOM.lower()})"), (5, torn)]
    got = found(spark, texts, [(1, TOM)])
    assert set(got) == {(i, 1) for i in (1, 2, 3, 4)}
    assert got[1, 1]["similarity"] == 1.0 and got[1, 1]["kind"] == "reparameterised"


def test_names_on_a_new_line_and_capitals_without_names(spark):
    lines = ITEM.replace("with Maria Lopez", "with\nMaria Lopez")
    got = found(spark, [(1, lines), (2, lines.replace("Maria Lopez", "John\nSmith")), (3, "The " + OTHER[4:].replace("noon on", "noon\nOn"))])
    assert set(got) == {(1, 1), (2, 1), (3, 2)}
    assert {r["similarity"] for r in got.values()} == {1.0}


def test_a_conflict_drops_its_windows_only(spark):
    item = "in 2019 the old mill by the river was sold to a baker who let it stand empty for many long years until the summer of 2019 when the whole roof fell in"
    one = item.replace("of 2019", "of 2020")
    clash = f"{item} and 5 men came".replace("fell in", "fell in on 8 cold winter nights of that year")
    texts = [(1, one), (2, item), (3, clash.replace("and 5 men", "and 8 men")), (4, item.replace("2019", "1987"))]
    got = found(spark, texts, [(1, item), (2, clash)])
    assert {(1, 1), (2, 1), (4, 1), (3, 2)} <= set(got)
    assert got[1, 1]["similarity"] < 1 and got[2, 1]["kind"] == "exact" and got[4, 1]["kind"] == "reparameterised"


def test_items_of_mostly_placeholders_are_found_as_they_are(spark):
    item = "5 kg 7 lbs 3 oz and 12 km 9 miles"
    texts = [(1, f"weights: {item} done"), (2, item.replace("7", "8")), (3, "5 kg"), (4, "6 kg")]
    assert set(found(spark, texts, [(1, item), (2, "5 kg")])) == {(1, 1), (1, 2), (2, 2), (3, 2)}


def test_very_long_runs_of_names_and_numbers(spark):
    names = " ".join(["Abc"] * 100_000)
    number = ".".join(["12"] * 100_000)
    texts = [(1, f"so {names} {ITEM} {names}"), (2, f"{names}\n{number} {ITEM}"), (3, f"{number}/{number} with {names}"), (4, "A" * 500_000 + " " + "b" * 500_000)]
    assert set(found(spark, texts, [(1, ITEM), (2, TOM)])) == {(1, 1), (2, 1)}


def test_bob_and_alice_with_other_numbers(spark):
    item = "Bob has 5 apples. Bob gives 2 to Carol. Carol eats 1 of them and Bob buys 4 more. How many apples does Bob have now?"
    again = "Alice has 7 apples. Alice gives 3 to Diana. Diana eats 2 of them and Alice buys 6 more. How many apples does Alice have now?"
    assert set(found(spark, [(1, f"Question: {again} Answer: 8"), (2, "Alice has apples")], [(1, item)])) == {(1, 1)}


def test_item_of_numbers_only_is_found_as_it_is(spark):
    item = "12 + 34 + 56 + 78 + 90 = 270"
    assert set(found(spark, [(1, f"sum: {item}!"), (2, item.replace("34", "35")), (3, OTHER)], [(1, item), (2, OTHER)])) == {(1, 1), (3, 2)}


def test_texts_without_anchors_hold_nothing(spark, monkeypatch):
    """The cheap pass changes no result: with it and without it, on texts of every case and mark."""
    items = [(1, ITEM), (2, TOM), (3, OTHER)]
    shapes = [lambda t, f=f: f(t) for f in (str.upper, str.lower, str.title, lambda t: t.replace(" ", "\n"), lambda t: t.replace(" ", ", "), lambda t: "Now" + t)]
    texts = [(10 * i + k, shape(t)) for i, t in items for k, shape in enumerate(shapes)]
    with_it = found(spark, texts, items)
    monkeypatch.setattr(decontaminate, "_with_anchors", lambda texts, anchors: texts)
    assert with_it == found(spark, texts, items) and len(with_it) > 9
