"""Benchmark decontamination by templates.

Numbers (digits or words), units and names become typed placeholders, so a question asked again with other parameters has the
template of the original. Windows of template words are hash-joined with those of the benchmark; where windows
hold placeholders, the values of document and item must map onto each other one to one along the passage. All
of it is DataFrame functions.

A capitalised word inside a sentence is a name. At the start of a text, sentence or line and after quotes, colons
or brackets it may be either, so texts and items are read twice: with such words as they are, and with every run of
capitalised words as one name. A first name and a full name there are one placeholder each.

Reading a text is dear, so a cheap pass comes first. Three neighbouring words inside a window of an item, none of them
a placeholder, stand side by side in any text that holds the window, in whatever case. Texts that lack them for more
windows than an item may miss cannot hold it and are not read further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, SIMILAR, ANCHOR = 5, 0.8, 3
#: Benchmark windows or anchors that are broadcast at most (16 bytes each and their words); beyond that, a shuffle join.
BROADCAST_WINDOWS = 500_000
#: Ids of documents that are broadcast at most (32 bytes each in ``drop_contaminated``).
BROADCAST_IDS = 500_000
#: Unit words that count as such after a number, and words that are numbers.
UNITS = (
    "mm cm m km millimetre millimetres millimeter millimeters centimetre centimetres centimeter centimeters metre metres meter meters kilometre kilometres kilometer kilometers "
    "inch inches ft feet foot yard yards mile miles hectare hectares acre acres mph kph kmh "
    "mg g kg t milligram milligrams gram grams kilogram kilograms kilo kilos tonne tonnes lb lbs oz ounce ounces ton tons "
    "ml cl l millilitre millilitres milliliter milliliters litre litres liter liters gallon gallons pint pints quart quarts cup cups "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years decade decades century centuries "
    "w kw mw gw wh kwh mwh gwh v a hz khz mhz ghz b kb mb gb tb watt watts kilowatt kilowatts megawatt megawatts volt volts amp amps hertz rpm "
    "byte bytes kilobyte kilobytes megabyte megabytes gigabyte gigabytes terabyte terabytes joule joules newton newtons pascal pascals "
    "degree degrees celsius fahrenheit kelvin usd eur gbp dollar dollars euro euros pound pounds cent cents yen franc francs rupee rupees percent"
).split()
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half"
).split()
# Possessive throughout: a run of very many names or numbers must not be kept on the stack.
_NUMBER = "[0-9]++(?:[.,:/][0-9]++)*+"
_NAME = r"\p{Lu}\p{Ll}++(?!\p{L})(?: \p{Lu}\p{Ll}++(?!\p{L}))*+"
_NUMBER_WORD = rf"(?<!\p{{L}})(?:{'|'.join(NUMBER_WORDS)})(?!\p{{L}})"
#: After a number in words, units of one letter are words.
_LONG_UNITS = [u for u in UNITS if len(u) > 1]
_OPEN_NAME, _OPEN_UNIT, _CLOSE = "\u0001", "\u0002", "\u0003"


def _marked(text: Column, everywhere: bool = False) -> Column:
    """Lower-case text with names and units between marks; characters that have a meaning here are taken out first.

    Names are capitalised words inside a sentence, or runs of capitalised words ``everywhere``.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), f"#{_OPEN_NAME}{_OPEN_UNIT}{_CLOSE}", "    ")
    names = F.regexp_replace(plain, rf"(\p{{Ll}}[,;]? |[0-9] )({_NAME})", f"$1{_OPEN_NAME}$2{_CLOSE}")
    if everywhere:
        names = F.regexp_replace(F.regexp_replace(plain, r"[\s\p{Z}]+", " "), rf"(?<!\p{{L}}){_NAME}", f"{_OPEN_NAME}$0{_CLOSE}")
    units = F.regexp_replace(names, rf"([0-9]) ?((?i:{'|'.join(UNITS)}))([^\p{{L}}0-9]|$)", f"$1 {_OPEN_UNIT}$2{_CLOSE}$3")
    units = F.regexp_replace(units, rf"((?i:{_NUMBER_WORD})) ((?i:{'|'.join(_LONG_UNITS)}))([^\p{{L}}0-9]|$)", f"$1 {_OPEN_UNIT}$2{_CLOSE}$3")
    return F.lower(units)


def _template(marked: Column) -> Column:
    names = F.regexp_replace(marked, f"{_OPEN_NAME}[^{_CLOSE}]*{_CLOSE}", "#p")
    units = F.regexp_replace(names, f"{_OPEN_UNIT}[^{_CLOSE}]*{_CLOSE}", "#u")
    return F.regexp_replace(F.regexp_replace(units, _NUMBER, "#n"), _NUMBER_WORD, "#n")


def words(rows: DataFrame, text_col: str, *keep: str, everywhere: bool = False) -> DataFrame:
    """``keep``, t (template words) and r (the words they stand for), of one length."""
    marked = rows.select(*keep, _marked(F.col(text_col), everywhere).alias("__m"))
    made = marked.withColumn("__t", _template(F.col("__m")))
    t = F.regexp_extract_all("__t", F.lit(r"#[pun]|\p{L}+"), F.lit(0))
    r = F.regexp_extract_all("__m", F.lit(rf"[{_OPEN_NAME}{_OPEN_UNIT}][^{_CLOSE}]*{_CLOSE}|{_NUMBER}|\p{{L}}+"), F.lit(0))
    return made.select(*keep, t.alias("t"), F.when(F.contains("__t", F.lit("#")), r).alias("r"))


def windows(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    """``keep``, pos, w (the window's template words in columns), usable, h (hash of the template words if usable, else of
    the words behind them) and r (words behind it, null without placeholders)."""
    n = F.size("t")
    parts = [F.slice("t", i + 1, F.greatest(n - i, F.lit(0))).alias(f"w{i}") for i in range(size)]
    zipped = F.arrays_zip(*parts, F.sequence(F.lit(0), n - 1).alias("pos"))
    some = rows.where(n >= size).select(*keep, "r", F.inline(zipped))
    names = [f"w{i}" for i in range(size)]
    some = some.where(F.col(names[-1]).isNotNull())
    r, usable = F.slice("r", F.col("pos") + 1, size), _usable(size)
    h = F.when(usable, F.xxhash64(*names)).otherwise(F.xxhash64(r))
    return some.select(*keep, "pos", *names, usable.alias("usable"), h.alias("h"), r.alias("r"))


def _usable(size: int) -> Column:
    """At least half of the words are literal: placeholders alone say nothing."""
    return sum((F.substring(f"w{i}", 1, 1) != "#").cast("int") for i in range(size)) * 2 >= size


def _plain_triples(texts: DataFrame, size: int) -> DataFrame:
    """(id, h): hashes of each ``size`` neighbouring runs of letters, in lower case, of texts (id, text)."""
    runs = texts.select("id", F.split(F.lower("text"), r"\P{L}+").alias("t"))
    parts = [F.slice("t", i + 1, F.greatest(F.size("t") - i, F.lit(0))).alias(f"w{i}") for i in range(size)]
    some = runs.where(F.size("t") >= size).select("id", F.inline(F.arrays_zip(*parts)))
    return some.where(F.col(f"w{size - 1}").isNotNull()).select("id", F.xxhash64(*(f"w{i}" for i in range(size))).alias("h"))


def _anchors(wanted: DataFrame, size: int, similar: float) -> tuple[DataFrame, bool]:
    """(h, item, version, weight, required) for the anchors of items: each window is told by its first run of words that
    are words, if it has one. A text that holds ``similar`` of an item's windows has anchors of ``required`` windows at
    least. And whether that is above zero for all items."""
    names = [f"w{i}" for i in range(size)]
    few = min(ANCHOR, size)
    runs = [F.array(*names[i : i + few]) for i in range(size - few + 1)]
    first = F.get(F.filter(F.array(*runs), lambda x: F.forall(x, lambda w: ~w.startswith("#"))), F.lit(0))
    some = wanted.select("item", "version", F.col("h").alias("window"), first.alias("first")).dropDuplicates(["item", "version", "window"])
    required = some.groupBy("item", "version").agg((F.lit(similar) * F.count("*") - F.count(F.when(F.col("first").isNull(), 1))).alias("required"))
    marks = some.where("first IS NOT NULL").select("item", "version", F.xxhash64(*(F.col("first")[i] for i in range(few))).alias("h"))
    marks = marks.groupBy("item", "version", "h").agg(F.count("*").alias("weight")).join(required, ["item", "version"])
    return common.materialize(marks.select("h", "item", "version", "weight", "required"), "anchors"), required.where("required <= 1e-9").isEmpty()


def _with_anchors(texts: DataFrame, anchors: dict[int, DataFrame]) -> DataFrame:
    """Those of texts (id, text) whose id has the anchors that an item requires; anchors by their number of words."""
    found = None
    for size, some in anchors.items():
        side = F.broadcast(some) if some.count() <= BROADCAST_WINDOWS else some
        met = _plain_triples(texts, size).join(side, "h").select("id", "item", "version", "h", "weight", "required").distinct()
        ids = met.groupBy("id", "item", "version").agg(F.sum("weight").alias("has"), F.max("required").alias("required"))
        ids = ids.where("has >= required - 1e-9").select(F.col("id").alias("met"))
        found = ids if found is None else found.unionByName(ids)
    found = _within_bound(common.materialize(found.distinct(), "candidates"))
    return common.materialize(texts.join(found, texts["id"].eqNullSafe(found["met"]), "left_semi"), "texts")


def _within_bound(ids: DataFrame) -> DataFrame:
    """Ids to join with texts: broadcast where their number is within bounds, so that texts stay where they are."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _met(texts: DataFrame, size: int, side: DataFrame, reading: int) -> DataFrame:
    """Windows of texts (id, text) that are windows of items: where, and the values of document and item if they hold placeholders."""
    names = [f"w{i}" for i in range(size)]
    own_windows = windows(words(texts, "text", "id", everywhere=bool(reading)), size, "id")
    met = own_windows.join(side, "h").where((F.struct(*names) == F.col("item_w")) & (F.col("usable") | (F.col("r") == F.col("item_r"))))
    both = F.arrays_zip(F.array(*names).alias("t"), F.col("item_r").alias("item"), F.col("r").alias("doc"))
    slots = F.transform(F.filter(both, lambda x: x["t"].startswith("#")), lambda x: F.struct(x["item"].alias("item"), x["doc"].alias("doc")))
    holds = F.exists(F.array(*names), lambda x: x.startswith("#"))
    shift = (F.col("pos") - F.col("item_pos")).alias("shift")
    return met.select("id", "item", "version", F.lit(reading).alias("reading"), F.col("h").alias("window"), shift, F.when(holds, slots).alias("slots"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds at least ``similar`` of the template windows.

    Columns: ``id_col``, ``item_col``, matched and windows (distinct template windows of the item, found and in
    all), similarity, changed_slots (placeholders with another value than in the item, at most over passages) and
    kind: exact, or reparameterised if values differ. Items of equal text are one item, named by the smallest id;
    items without words match nothing; items shorter than five words are one window. Windows that are mostly placeholders
    are left out, but if an item has no others they must be there with the item's own values. Rows that share an id are
    one document, rows with null ids as well. Null texts have no words; very long texts are read whole. Without documents
    or without items there are no pairs.
    """
    items = benchmark.groupBy(F.col(item_text).alias("text")).agg(F.min(item_col).alias("item")).where("item IS NOT NULL")
    read = [words(items, "text", "item", everywhere=bool(v)).withColumn("version", F.lit(v)) for v in (0, 1)]
    items = read[0].unionByName(read[1]).where(F.size("t") > 0).groupBy("item", "t").agg(F.min_by("r", "version").alias("r"), F.min("version").alias("version"))
    items = common.materialize(items, "items")
    # Without names in the benchmark the second reading of a text meets nothing that the first does not.
    readings = (0, 1) if not items.where(F.array_contains("t", "#p")).isEmpty() else (0,)
    sizes = [r[0] for r in items.select(F.least(F.size("t"), F.lit(WINDOW)).alias("s")).distinct().collect()]  # 1 to WINDOW
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sides, totals, anchors, held = [], [], {}, True
    for size in sorted(sizes):
        own = items.where(F.least(F.size("t"), F.lit(WINDOW)) == size)
        names = [f"w{i}" for i in range(size)]
        every = windows(own, size, "item", "version")
        some = every.groupBy("item").agg(F.max("usable").alias("some"))
        literal = ~F.col("some") & (F.col("version") == 0)
        wanted = common.materialize(every.join(some, "item").where(F.col("usable") | literal).drop("some"), "wanted")
        totals.append(wanted.groupBy("item", "version").agg(F.countDistinct("h", *names).alias("windows")))
        marks, all_held = _anchors(wanted, size, similar)
        held, few = held and all_held, min(ANCHOR, size)
        anchors[few] = anchors[few].unionByName(marks) if few in anchors else marks
        side = wanted.select("item", "version", "h", F.struct(*names).alias("item_w"), F.col("pos").alias("item_pos"), F.col("r").alias("item_r"))
        sides.append((size, F.broadcast(side) if wanted.count() <= BROADCAST_WINDOWS else side))
    # An item that is mostly placeholders has no anchors to go by: then every text is read.
    texts = _with_anchors(texts, anchors) if sides and held else texts
    found = []
    for reading in readings if sides else ():
        met = [_met(texts, size, side, reading) for size, side in sides]
        some = met[0]
        for m in met[1:]:
            some = some.unionByName(m)
        found.append(common.materialize(some.distinct(), "hits"))
    if not found:
        kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
        return _result(docs.sparkSession.createDataFrame([], f"id {kind}, item {item_kind}, matched bigint, windows bigint, changed int"), id_col, item_col)
    hits, all_totals = found[0], totals[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    for t in totals[1:]:
        all_totals = all_totals.unionByName(t)
    # One to one: along one alignment no value may stand for two, on either side. Windows with such a value do not count,
    # unless it is the item's own.
    key = ["id", "item", "version", "reading", "shift"]
    pairs = hits.where("slots IS NOT NULL").select(*key, F.explode("slots").alias("s"))
    pairs = pairs.select(*key, F.col("s.item").alias("of"), F.col("s.doc").alias("to")).distinct()
    twice = [pairs.groupBy(*key, F.col(c).alias("value")).count().where("count > 1").withColumn("side", F.lit(c)) for c in ("of", "to")]
    values = [F.collect_set(F.when(F.col("side") == c, F.col("value"))).alias(f"torn_{c}") for c in ("of", "to")]
    torn = twice[0].unionByName(twice[1]).groupBy(*(F.col(k).alias(f"at_{k}") for k in key)).agg(*values)
    clash = F.col("id").eqNullSafe(F.col("at_id"))
    for k in key[1:]:
        clash = clash & (F.col(k) == F.col(f"at_{k}"))
    in_torn = lambda s: (s["item"] != s["doc"]) & (F.array_contains("torn_of", s["item"]) | F.array_contains("torn_to", s["doc"]))
    kept = hits.join(torn, clash, "left").where(~F.coalesce(F.exists("slots", in_torn), F.lit(False))).select(*hits.columns)
    changed = F.coalesce(F.size(F.array_distinct(F.filter("slots", lambda s: s["item"] != s["doc"]))), F.lit(0))
    pairs_found = kept.groupBy("id", "item", "version").agg(F.countDistinct("window").alias("matched"), F.max(changed).alias("changed"))
    scored = pairs_found.join(all_totals, ["item", "version"]).where(F.col("matched") >= F.lit(similar) * F.col("windows"))
    # The second reading of an item counts where the first is not found.
    best = F.min_by(F.struct("matched", "windows", "changed"), "version")
    return _result(scored.groupBy("id", "item").agg(best.alias("best")).select("id", "item", "best.*"), id_col, item_col)


def _result(scored: DataFrame, id_col: str, item_col: str) -> DataFrame:
    return scored.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("matched").cast("bigint").alias("matched"), F.col("windows").cast("bigint").alias("windows"),
        F.round(F.col("matched") / F.col("windows"), 6).alias("similarity"), F.col("changed").cast("int").alias("changed_slots"),
        F.when(F.col("changed") > 0, "reparameterised").otherwise("exact").alias("kind"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, all columns as they are. Rows are known by a hash of
    their text, so ids may be null or repeated."""
    key = common.free("digest", docs.columns)
    keyed = docs.withColumn(key, F.unhex(F.sha2(F.coalesce(text_col, F.lit("")).cast("binary"), 256)))
    hashed = keyed.select(F.col(key).alias("of"), F.col(text_col).alias("text"))
    bad = common.materialize(contaminated(hashed, benchmark, "of").select(F.col("of").alias(key)).distinct(), "bad")
    return keyed.join(_within_bound(bad), key, "left_anti").select(*docs.columns)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
