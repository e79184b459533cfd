"""Queries that classify and score: statuses by ordered rules, capped scores, gates, votes, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratelake.functions.rates import canonical_label
from ratelake.functions.text import word_count
from ratelake.operators.compare import band, score
from ratelake.operators.latest import first_of, union_distinct
from ratelake.streaming.usage import sessions

from .registry import query, table

_RIDER_SQL = """WITH v AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 90 END AS b, coalesce(n, 0) AS charges
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey),
    r AS (SELECT c_custkey, DATE '1995-06-01' + CAST(c_custkey % 2400 AS INTEGER) AS ref FROM customer),
    f AS (SELECT o_custkey, min(a) AS first FROM v GROUP BY 1),
    m AS (SELECT c_custkey, ref, first, a, charges FROM r LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN v ON v.o_custkey = c_custkey AND a <= ref AND (b IS NULL OR b >= ref)
        QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY a DESC NULLS LAST, o_orderkey DESC NULLS LAST) = 1),
    s AS (SELECT c_custkey, CASE WHEN first IS NULL THEN 'no_rider' WHEN ref < first THEN 'before_first' WHEN a IS NULL THEN 'none_active' WHEN charges = 0 THEN 'zero_charges' WHEN a = ref THEN 'same_day' ELSE 'carried_forward' END AS status FROM m)"""


def _rider_status(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's rider as of a date: absent, not begun, none active, without charges, of the day, or carried forward."""
    charges = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("charges"))
    day = F.to_date("o_orderdate")
    versions = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), day.alias("a"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, 90)).alias("b")).join(charges, "o_orderkey", "left")
    ref = F.date_add(F.lit("1995-06-01").cast("date"), (F.col("c_custkey") % 2400).cast("int"))
    asked = table(spark, d, "customer").select("c_custkey", ref.alias("ref"))
    firsts = versions.groupBy("c_custkey").agg(F.min("a").alias("first"))
    live = asked.join(versions, "c_custkey").where((F.col("a") <= F.col("ref")) & (F.col("b").isNull() | (F.col("b") >= F.col("ref"))))
    best = first_of(live, ["c_custkey"], [F.desc("a"), F.desc("o_orderkey")]).select("c_custkey", "a", F.coalesce("charges", F.lit(0)).alias("charges"))
    met = asked.join(firsts, "c_custkey", "left").join(best, "c_custkey", "left")
    status = (
        F.when(F.col("first").isNull(), "no_rider").when(F.col("ref") < F.col("first"), "before_first").when(F.col("a").isNull(), "none_active")
        .when(F.col("charges") == 0, "zero_charges").when(F.col("a") == F.col("ref"), "same_day").otherwise("carried_forward")
    )
    return met.select("c_custkey", status.alias("status"))


@query(f"{_RIDER_SQL} SELECT c_custkey, status FROM s")
def rider_status_asof(spark: SparkSession, d: str) -> DataFrame:
    return _rider_status(spark, d)


@query(f"""{_RIDER_SQL}, n AS (SELECT n_name, sum(CASE status WHEN 'none_active' THEN 12 WHEN 'zero_charges' THEN 10 WHEN 'before_first' THEN 3 ELSE 0 END) / 10.0 + CASE WHEN max(CASE WHEN status = 'none_active' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN status = 'zero_charges' THEN 1 ELSE 0 END) = 1 THEN 6 ELSE 0 END
        + CASE WHEN max(CASE WHEN status IN ('same_day', 'carried_forward') THEN 1 ELSE 0 END) = 0 THEN 4 ELSE 0 END AS severity, count(*) AS n FROM s JOIN customer USING (c_custkey) JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT n_name, CAST(severity AS DOUBLE) AS severity, CASE WHEN severity >= 80 THEN 'high' WHEN severity >= 35 THEN 'medium' ELSE 'low' END AS band, n FROM n""")
def rider_action_severity(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the statuses in each place, with surcharges for bad combinations."""
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    status = F.col("status")
    weight = F.when(status == "none_active", 12).when(status == "zero_charges", 10).when(status == "before_first", 3).otherwise(0)
    has = lambda *s: F.max(status.isin(*s))
    sums = _rider_status(spark, d).join(people, "c_custkey").groupBy("n_name").agg(F.sum(weight).alias("w"), has("none_active").alias("x"), has("zero_charges").alias("z"), has("same_day", "carried_forward").alias("good"), F.count("*").alias("n"))
    severity = F.col("w") / 10.0 + score((F.col("x") & F.col("z"), 6), (~F.col("good"), 4))
    return sums.select("n_name", severity.alias("severity"), band(severity, 80, 35).alias("band"), "n")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders),
    g AS (SELECT o_custkey, coalesce(max(nxt - day), 0) AS gap, sum(CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) AS sup, sum(CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END) AS ord, sum(CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END) AS unp FROM o GROUP BY 1),
    s AS (SELECT o_custkey, gap, least(40, 18 * sup) + least(30, 8 * ord) + least(20, gap // 90) + least(25, 12 * unp) AS p FROM g)
    SELECT o_custkey, CAST(gap AS INTEGER) AS largest_gap_days, CAST(p AS BIGINT) AS priority, CASE WHEN p >= 70 THEN 'high' WHEN p >= 35 THEN 'medium' ELSE 'low' END AS band FROM s""")
def missing_document_score(spark: SparkSession, d: str) -> DataFrame:
    """Capped points for missing predecessors, numbers, pairs and the largest gap."""
    nxt = F.lead("day").over(Window.partitionBy("o_custkey").orderBy("day", "o_orderkey"))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day")).withColumn("gap", F.datediff(nxt, "day"))
    n = lambda m: F.sum((F.col("o_orderkey") % m == 0).cast("int"))
    sums = rows.groupBy("o_custkey").agg(F.coalesce(F.max("gap"), F.lit(0)).alias("gap"), n(11).alias("sup"), n(13).alias("ord"), n(17).alias("unp"))
    cap = lambda most, x: F.least(F.lit(most), x)
    points = (cap(40, 18 * F.col("sup")) + cap(30, 8 * F.col("ord")) + cap(20, F.expr("gap div 90")) + cap(25, 12 * F.col("unp"))).cast("bigint")
    return sums.select("o_custkey", F.col("gap").alias("largest_gap_days"), points.alias("priority"), band(points, 70, 35).alias("band"))


#: Patterns of each document type with a weight for each hit.
DOC_TYPES = [
    ("licensed", r"(?i)licen[sc]e", 8.0), ("licensed", r"(?i)copyright", 4.0), ("credentials", r"(?i)password|secret|token|api_?key", 6.0),
    ("contact", r"[a-z0-9.]+@[a-z0-9]+", 5.0), ("contact", r"[0-9]{3}-[0-9]{4}", 3.0), ("tabular", r" \| ", 0.5), ("decorated", r"[*%#$&]{3}", 0.25),
]
_TYPES_SQL = ", ".join(f"('{t}', '{p}', {w})" for t, p, w in DOC_TYPES)


@query(f"""WITH h AS (SELECT doc_id, t, sum(len(regexp_extract_all(text, p)) * w) AS sc FROM documents, (VALUES {_TYPES_SQL}) x(t, p, w) GROUP BY 1, 2),
    b AS (SELECT *, lead(sc) OVER w AS second, row_number() OVER w AS i FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY sc DESC, t))
    SELECT doc_id, CASE WHEN sc > 0 THEN t ELSE 'unknown' END AS doc_type, CAST(sc AS DOUBLE) AS score,
        round(CAST(CASE WHEN sc <= 0 THEN 0 WHEN sc >= 8 THEN least(0.99, 0.9 + CASE WHEN sc - second >= 5 THEN 0.02 ELSE 0 END) ELSE least(0.65, greatest(0.2, sc / 6)) END AS DOUBLE), 6) AS confidence FROM b WHERE i = 1""")
def document_type_rules(spark: SparkSession, d: str) -> DataFrame:
    """The type whose patterns weigh most, and how sure that is."""
    total: dict[str, object] = {}
    for kind, pattern, weight in DOC_TYPES:
        total[kind] = total.get(kind, F.lit(0.0)) + F.regexp_count("text", F.lit(pattern)) * weight
    ranked = F.array_sort(F.array(*(F.struct((-s).alias("minus"), F.lit(k).alias("kind")) for k, s in total.items())))
    rows = table(spark, d, "documents").select("doc_id", ranked.alias("r")).select("doc_id", F.col("r")[0]["kind"].alias("kind"), (-F.col("r")[0]["minus"]).alias("score"), (-F.col("r")[1]["minus"]).alias("second"))
    strong = F.least(F.lit(0.99), 0.9 + F.when(F.col("score") - F.col("second") >= 5, 0.02).otherwise(0.0))
    sure = F.when(F.col("score") <= 0, 0.0).when(F.col("score") >= 8, strong).otherwise(F.least(F.lit(0.65), F.greatest(F.lit(0.2), F.col("score") / 6)))
    return rows.select("doc_id", F.when(F.col("score") > 0, F.col("kind")).otherwise("unknown").alias("doc_type"), "score", F.round(sure, 6).alias("confidence"))


@query("""WITH c AS (SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS kinds, avg(least(length(text), 800)) / 800 AS conf, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS doc FROM conversations GROUP BY 1)
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN turns < 2 THEN 'unknown_type' WHEN conf < 0.35 THEN 'low_confidence' WHEN doc = 1 AND kinds < 3 THEN 'conflict' WHEN kinds < 2 THEN 'too_few_agree' ELSE 'promoted' END AS reason FROM c) GROUP BY 1""")
def section_promotion_gates(spark: SparkSession, d: str) -> DataFrame:
    """Ordered gates; the first that fails is the reason."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.countDistinct("role").alias("kinds"), (F.avg(F.least(F.length("text"), F.lit(800))) / 800).alias("conf"), F.max(F.col("role") == "system").alias("doc")
    )
    reason = F.when(F.col("turns") < 2, "unknown_type").when(F.col("conf") < 0.35, "low_confidence").when(F.col("doc") & (F.col("kinds") < 3), "conflict").when(F.col("kinds") < 2, "too_few_agree").otherwise("promoted")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey) AS total FROM v),
    w AS (SELECT l_suppkey, p_brand, n / total AS purity, n / total * least(1, total / 50) AS weight FROM t WHERE total >= 5)
    SELECT l_suppkey, p_brand, round(purity, 6) AS purity, round(weight, 6) AS weight FROM w QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, p_brand) = 1""")
def purity_votes(spark: SparkSession, d: str) -> DataFrame:
    """The value that most of a key's rows have, weighed by how pure and how well supported it is."""
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    n = table(spark, d, "lineitem").join(brands, "l_partkey").groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n"))
    rows = n.withColumn("total", F.sum("n").over(Window.partitionBy("l_suppkey"))).where("total >= 5")
    purity = F.col("n") / F.col("total")
    best = first_of(rows.withColumn("weight", purity * F.least(F.lit(1.0), F.col("total") / 50)), ["l_suppkey"], [F.desc("weight"), "p_brand"])
    return best.select("l_suppkey", "p_brand", F.round(purity, 6).alias("purity"), F.round("weight", 6).alias("weight"))


@query("""WITH b AS (SELECT o_custkey, o_orderpriority, o_totalprice, lead(CAST(o_orderkey AS DOUBLE)) OVER w - o_orderkey AS width FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT o_custkey, round(sum(least(coalesce(width, 1000), 1000) * 0.01), 4) AS blended, round(max(o_totalprice), 2) AS top FROM b GROUP BY 1""")
def representative_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps of blocks that end where the next begins, the last open, up to a representative amount."""
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, d, "orders").select("o_custkey", "o_totalprice", (nxt - F.col("o_orderkey")).cast("double").alias("width"))
    amount = F.least(F.coalesce("width", F.lit(1000.0)), F.lit(1000.0)) * 0.01
    return rows.groupBy("o_custkey").agg(F.round(F.sum(amount), 4).alias("blended"), F.round(F.max("o_totalprice"), 2).alias("top"))


@query("""WITH a AS (SELECT l_suppkey, sum(l_tax) AS parts FROM lineitem GROUP BY 1), t AS (SELECT s_suppkey, s_acctbal / 1000 AS total FROM supplier)
    SELECT s_suppkey, round(coalesce(parts, 0), 4) AS parts, round(total, 5) AS total, CASE WHEN parts IS NULL THEN 'no_parts' WHEN abs(parts - total) <= 1e-4 THEN 'ok' WHEN parts > total THEN 'over' ELSE 'under' END AS status FROM t LEFT JOIN a ON l_suppkey = s_suppkey""")
def rider_total_check(spark: SparkSession, d: str) -> DataFrame:
    """The sum of parts against the stated total, within a small tolerance."""
    parts = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_tax").alias("p"))
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("t")).join(parts, "s_suppkey", "left")
    status = F.when(F.col("p").isNull(), "no_parts").when(F.abs(F.col("p") - F.col("t")) <= 1e-4, "ok").when(F.col("p") > F.col("t"), "over").otherwise("under")
    return rows.select("s_suppkey", F.round(F.coalesce("p", F.lit(0.0)), 4).alias("parts"), F.round("t", 5).alias("total"), status.alias("status"))


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")
def usage_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of a user's events without a pause of two hours."""
    out = sessions(table(spark, d, "events"), "2 hours")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 6).alias("total"))


@query("""SELECT DISTINCT p_name, trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9]+', '_', 'g'), '_') AS label FROM part""")
def label_canonicalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_name", canonical_label(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("label")).distinct()


@query("""WITH d AS (SELECT *, count(*) OVER (PARTITION BY text) AS copies, row_number() OVER (PARTITION BY text ORDER BY quality DESC NULLS LAST, toxic NULLS LAST, doc_id) AS i FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, copies FROM d WHERE i = 1 AND copies > 1""")
def duplicate_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Of each group of equal documents the best labelled, then the oldest."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    rows = docs.join(table(spark, d, "labels"), "doc_id", "left")
    best = first_of(rows, ["h"], [F.desc_nulls_last("quality"), F.asc_nulls_last("toxic"), "doc_id"])
    return best.join(docs.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1"), "h").select("doc_id", "copies")


@query("""WITH d AS (SELECT doc_id, lang, n_chars, quality, toxic, text FROM documents LEFT JOIN labels USING (doc_id)),
    i AS (SELECT doc_id, 'no_label' AS issue FROM d WHERE quality IS NULL UNION ALL SELECT doc_id, 'toxic' FROM d WHERE toxic = 1 UNION ALL SELECT doc_id, 'poor' FROM d WHERE quality = 0
        UNION ALL SELECT doc_id, 'short' FROM d WHERE n_chars < 200 UNION ALL SELECT doc_id, 'one_line' FROM d WHERE position(chr(10) IN text) = 0),
    s AS (SELECT doc_id, max(CASE WHEN issue IN ('toxic', 'poor') THEN 2 WHEN issue IS NOT NULL THEN 1 ELSE 0 END) AS lvl, count(issue) AS n FROM d LEFT JOIN i USING (doc_id) GROUP BY 1)
    SELECT CASE lvl WHEN 2 THEN 'blocking' WHEN 1 THEN 'warning_only' ELSE 'clean' END AS state, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_issues FROM s GROUP BY 1""")
def lineage_validation(spark: SparkSession, d: str) -> DataFrame:
    """Issues of each document, and how many documents are blocked, warned of, or clean."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rules = {"no_label": F.col("quality").isNull(), "toxic": F.col("toxic") == 1, "poor": F.col("quality") == 0, "short": F.col("n_chars") < 200, "one_line": ~F.contains("text", F.lit("\n"))}
    issues = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    state = F.when(F.arrays_overlap("issues", F.array(F.lit("toxic"), F.lit("poor"))), "blocking").when(F.size("issues") > 0, "warning_only").otherwise("clean")
    return rows.select(issues.alias("issues")).groupBy(state.alias("state")).agg(F.count("*").alias("n_docs"), F.sum(F.size("issues").cast("bigint")).alias("n_issues"))


@query("""SELECT o_orderkey, min(reason) AS reason, max(priority) AS priority FROM (SELECT o_orderkey, 'pending' AS reason, 2 AS priority FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT o_orderkey, 'stale', 1 FROM orders o WHERE o_orderdate < TIMESTAMP '1995-07-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)) GROUP BY 1""")
def stale_artifact_union(spark: SparkSession, d: str) -> DataFrame:
    """Two work lists in one, each item once with its highest priority."""
    orders = table(spark, d, "orders")
    pending = orders.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("pending").alias("reason"), F.lit(2).alias("priority"))
    big = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    stale = orders.where("o_orderdate < '1995-07-01'").join(big, "o_orderkey", "left_semi").select("o_orderkey", F.lit("stale").alias("reason"), F.lit(1).alias("priority"))
    return union_distinct(pending, stale).groupBy("o_orderkey").agg(F.min("reason").alias("reason"), F.max("priority").alias("priority"))


@query("""SELECT lang, CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+'))) AS BIGINT) AS before_hits, CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9.]+@[a-z0-9]+\\.example\\.com'))) AS BIGINT) AS after_hits,
    sum(CASE WHEN regexp_matches(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+') AND NOT regexp_matches(text, '[A-Za-z0-9.]+@[a-z0-9]+\\.example\\.com') THEN 1 ELSE 0 END)::BIGINT AS lost_docs FROM documents GROUP BY 1""")
def regex_shadow(spark: SparkSession, d: str) -> DataFrame:
    """A pattern and its proposed successor side by side."""
    old, new = "[A-Za-z0-9.]+@[A-Za-z0-9.]+", r"[A-Za-z0-9.]+@[a-z0-9]+\.example\.com"
    # Both patterns need an @; without one they would try every start of every run of letters in vain.
    hits = lambda p: F.when(F.contains("text", F.lit("@")), F.regexp_count("text", F.lit(p))).otherwise(0).cast("bigint")
    rows = table(spark, d, "documents").select("lang", hits(old).alias("o"), hits(new).alias("n"))
    lost = F.sum(((F.col("o") > 0) & (F.col("n") == 0)).cast("bigint"))
    return rows.groupBy("lang").agg(F.sum("o").alias("before_hits"), F.sum("n").alias("after_hits"), lost.alias("lost_docs"))


@query("""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\n]+')) AS words, len(regexp_extract_all(text, '[0-9]+')) AS numbers, string_split(text, chr(10)) AS lines FROM documents)
    SELECT doc_id, round(len(list_filter(lines, lambda x: x LIKE '%|%')) / len(lines), 6) AS table_density, round(least(1.0, greatest(0.0, len(list_filter(lines, lambda x: length(x) < 20)) / len(lines))), 6) AS reading_risk,
        round(numbers / greatest(words, 1), 6) AS number_density FROM w""")
def layout_density(spark: SparkSession, d: str) -> DataFrame:
    """Shares of table-like and of very short lines, and numbers for each word."""
    lines = F.split("text", "\n")
    share = lambda cond: F.size(F.filter(lines, cond)) / F.size(lines)
    return table(spark, d, "documents").select(
        "doc_id", F.round(share(lambda x: F.contains(x, F.lit("|"))), 6).alias("table_density"),
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share(lambda x: F.length(x) < 20))), 6).alias("reading_risk"),
        F.round(F.regexp_count("text", F.lit("[0-9]+")) / F.greatest(word_count(F.col("text")), F.lit(1)), 6).alias("number_density"),
    )


@query("""WITH s AS (SELECT d.doc_id, i.item_id, len(list_intersect(list_distinct(string_split(lower(d.head), ' ')), list_distinct(string_split(lower(i.text), ' ')))) AS shared FROM (SELECT doc_id, text AS head FROM documents) d, benchmark i)
    SELECT doc_id, item_id, least(60, 3 * shared) AS points FROM s WHERE least(60, 3 * shared) >= 20 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, item_id) = 1""")
def family_matcher(spark: SparkSession, d: str) -> DataFrame:
    """Every document against every candidate, by words in common, which join by equality; the best of at least 20 points."""
    words = F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word")
    documents, families = table(spark, d, "documents").select("doc_id", words), table(spark, d, "benchmark").select("item_id", words)
    pairs = documents.join(families, "word").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    points = F.least(F.lit(60), 3 * F.col("shared"))
    return first_of(pairs.where(points >= 20), ["doc_id"], [F.desc("shared"), "item_id"]).select("doc_id", "item_id", points.alias("points"))


@query()
def baseline_text_model(spark: SparkSession, d: str) -> DataFrame:
    """Balanced logistic regression on TF-IDF of words and pairs, learnt on three quarters of the labels: correct and total
    of the rest. SQL cannot express it; the tests hold its accuracy against a bound."""
    from .text_model import evaluate_baseline

    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return evaluate_baseline(rows)

