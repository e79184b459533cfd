"""Queries over time lines and evidence: coverage by versions, the snapshot that explains a bill, sections and identities of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.operators import coverage, documents, evidence
from ratelake.operators.latest import first_of
from ratelake.operators.lineage import lineage_gaps
from ratelake.operators.nearest import best_snapshot
from ratelake.operators.sections import build_sections

from .registry import query, table

#: Orders as versions of a customer's tariff: some without a start, without an end, or with an end before the start.
_VERSIONS_SQL = """v AS (SELECT o_orderkey AS id, o_custkey AS k, CASE WHEN o_orderkey % 40 <> 0 THEN CAST(o_orderdate AS DATE) END AS a,
        CASE WHEN o_orderkey % 50 = 3 THEN NULL WHEN o_orderkey % 60 = 1 THEN CAST(o_orderdate AS DATE) - 5 ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey * 7 % 300 AS INTEGER) END AS z FROM orders),
    d AS (SELECT * FROM v WHERE a IS NOT NULL AND (z IS NULL OR z >= a)),
    g AS (SELECT k, CAST(unnest(generate_series(min(a), max(coalesce(z, a)) + CASE WHEN count(*) > count(z) THEN 1 ELSE 0 END, INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY k),
    c AS (SELECT g.k, day, count(d.id) AS n, CASE count(d.id) WHEN 0 THEN 'gap' WHEN 1 THEN 'single' ELSE 'overlap' END AS kind FROM g LEFT JOIN d ON d.k = g.k AND d.a <= day AND (d.z IS NULL OR d.z >= day) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY day) - row_number() OVER (PARTITION BY k, kind ORDER BY day) AS run FROM c),
    m AS (SELECT k, kind, run, min(day) AS starts, max(day) AS last, count(*) AS days, max(n) AS most FROM r GROUP BY 1, 2, 3),
    o AS (SELECT k, max(day) AS final, bool_or(z IS NULL) AS open FROM c JOIN (SELECT k, z FROM d) USING (k) GROUP BY 1),
    s AS (SELECT m.k, kind, starts, CASE WHEN NOT (open AND last = final) THEN last END AS ends, CASE WHEN NOT (open AND last = final) THEN days END AS days, most FROM m JOIN o USING (k))"""


def _versions(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    end = F.when(F.col("o_orderkey") % 50 == 3, None).when(F.col("o_orderkey") % 60 == 1, F.date_sub(day, 5)).otherwise(F.date_add(day, (F.col("o_orderkey") * 7 % 300).cast("int")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 40 != 0, day).alias("a"), end.alias("z"))


@query(f"""WITH {_VERSIONS_SQL}
    SELECT s.k AS family, kind, CAST(starts AS VARCHAR) AS starts, CAST(ends AS VARCHAR) AS ends, coalesce(days, -1) AS days, most, CAST((SELECT max(id) FROM d WHERE d.k = s.k AND d.z = s.starts - 1) AS VARCHAR) AS predecessor,
        CAST((SELECT min(id) FROM d WHERE d.k = s.k AND d.a = s.ends + 1) AS VARCHAR) AS successor FROM s
    UNION ALL SELECT k, CASE WHEN a IS NULL THEN 'undated_version' ELSE 'inverted_version' END, NULL, NULL, -1, 0, NULL, CAST(id AS VARCHAR) FROM v WHERE a IS NULL OR z < a""")
def version_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Each family's time line: gaps, stretches under one version and overlaps, with their neighbours, and versions that are not on it."""
    versions = _versions(spark, d)
    line = coverage.stretches(versions, ["k"], "a", "z", "id").select(
        F.col("k").alias("family"), "kind", F.col("starts").cast("string").alias("starts"), F.col("ends").cast("string").alias("ends"), F.coalesce("days", F.lit(-1)).alias("days"), "most",
        F.col("before").cast("string").alias("predecessor"), F.col("after").cast("string").alias("successor"),
    )
    odd = coverage.flaws(versions, ["k"], "a", "z", "id").select(F.col("k").alias("family"), "kind", F.lit(-1).alias("days"), F.lit(0).alias("most"), F.col("id").cast("string").alias("successor"))
    return line.unionByName(odd, allowMissingColumns=True)


@query(f"""WITH {_VERSIONS_SQL},
    t AS (SELECT k, count(*) AS versions, count(*) FILTER (a IS NULL) AS undated, count(*) FILTER (z < a) AS inverted FROM v GROUP BY 1),
    n AS (SELECT k, count(*) FILTER (kind = 'gap') AS n_gaps, coalesce(sum(days) FILTER (kind = 'gap'), 0) AS gap_days, count(*) FILTER (kind = 'overlap') AS n_overlaps,
        coalesce(sum(days) FILTER (kind = 'overlap'), 0) AS overlap_days FROM s GROUP BY 1)
    SELECT t.k AS family, versions, coalesce(n_gaps, 0) AS n_gaps, CAST(coalesce(gap_days, 0) AS BIGINT) AS gap_days, coalesce(n_overlaps, 0) AS n_overlaps, CAST(coalesce(overlap_days, 0) AS BIGINT) AS overlap_days, undated, inverted,
        CASE WHEN versions = undated THEN 'undated' WHEN n_gaps > 0 THEN 'gaps_exist' WHEN n_overlaps > 0 THEN 'overlaps_exist' WHEN undated + inverted > 0 THEN 'flawed' ELSE 'complete' END AS status
    FROM t LEFT JOIN n USING (k)""")
def temporal_map(spark: SparkSession, d: str) -> DataFrame:
    """Gaps, overlaps and flawed versions of each family, and what they make of its time line."""
    return coverage.timeline_status(_versions(spark, d), ["k"], "a", "z", "id").withColumnRenamed("k", "family")


@query("""WITH b AS (SELECT row_number() OVER () AS b, l_orderkey, l_linenumber, 'Brand#' || (l_suppkey % 25 + 1) AS component, l_extendedprice / 100 AS amount, l_quantity AS kwh FROM lineitem),
    s AS (SELECT p_brand AS component, CASE WHEN p_partkey % 10 = 0 THEN 'fixed_monthly' ELSE 'cents_per_kwh' END AS unit,
        CAST(round(p_retailprice * (1 + p_partkey % 37 / 1000.0::DOUBLE) * CASE WHEN p_partkey % 10 = 0 THEN 0.2::DOUBLE ELSE 1 END * 10000) AS BIGINT) / 10000.0::DOUBLE AS value, DATE '1995-01-01' + CAST(p_partkey % 2000 AS INTEGER) AS since FROM part),
    e AS (SELECT b.*, unit, value, since, CASE WHEN unit = 'fixed_monthly' THEN value ELSE kwh * value / 100.0::DOUBLE END AS estimate FROM b JOIN s USING (component)),
    f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY b ORDER BY abs(amount - estimate), since, value) = 1)
    SELECT l_orderkey, l_linenumber, component, unit, value, CAST(since AS VARCHAR) AS since, round(amount - estimate, 6) AS difference FROM f""")
def best_snapshot_fit(spark: SparkSession, d: str) -> DataFrame:
    """For each bill line the snapshot of its component, of all dates and both units, that comes closest to its amount."""
    c = F.col
    brand = F.concat(F.lit("Brand#"), (c("l_suppkey") % 25 + 1).cast("string"))
    bills = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", brand.alias("component"), (c("l_extendedprice") / 100).alias("amount"), c("l_quantity").alias("kwh"))
    fixed = c("p_partkey") % 10 == 0
    value = c("p_retailprice") * (1 + c("p_partkey") % 37 / 1000.0) * F.when(fixed, 0.2).otherwise(1.0)
    snapshots = table(spark, d, "part").select(
        c("p_brand").alias("component"), F.when(fixed, "fixed_monthly").otherwise("cents_per_kwh").alias("unit"), value.alias("value"),
        F.date_add(F.lit("1995-01-01").cast("date"), (c("p_partkey") % 2000).cast("int")).alias("since"),
    )
    best = best_snapshot(bills, snapshots, ["l_orderkey", "l_linenumber"], "component", "amount", "kwh", "unit", "value", "since")
    return best.drop("estimate").withColumns({"since": c("since").cast("string"), "difference": F.round("difference", 6)})


_WEIGHTS = {"1-URGENT": 3.0, "2-HIGH": 2.5, "3-MEDIUM": 2.0, "4-NOT SPECIFIED": 1.5}


@query("""WITH v AS (SELECT o_custkey AS k, o_orderpriority AS s, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus || o_orderkey % 4 END AS label, least(1.0, o_totalprice / 500000) AS conf, o_orderdate AS day, o_orderkey AS id FROM orders),
    l AS (SELECT k, label, round(conf * CASE s WHEN '1-URGENT' THEN 3.0 WHEN '2-HIGH' THEN 2.5 WHEN '3-MEDIUM' THEN 2.0 WHEN '4-NOT SPECIFIED' THEN 1.5 ELSE 1.0 END, 9) AS p FROM v QUALIFY row_number() OVER (PARTITION BY k, s ORDER BY day DESC, id DESC) = 1),
    t AS (SELECT k, label, sum(p) AS p, count(*) AS n FROM l WHERE label IS NOT NULL AND p > 0 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(p, 9) DESC, label) AS place FROM t),
    f AS (SELECT k, max(label) FILTER (place = 1) AS first, coalesce(max(p) FILTER (place = 1), 0) AS a, max(label) FILTER (place = 2) AS second, coalesce(max(p) FILTER (place = 2), 0) AS b, sum(p) AS total, CAST(sum(n) AS BIGINT) AS voters FROM r GROUP BY 1),
    x AS (SELECT k, count(*) AS votes, list_sort(list(DISTINCT c) FILTER (regexp_matches(c, '^[A-Z]{2,5}-?[0-9]{1,3}[A-Z]?$'))) AS codes
        FROM (SELECT o_custkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END || 'S-' || o_orderkey % 1200 AS c FROM orders) GROUP BY 1),
    y AS (SELECT x.k, votes, coalesce(codes, []) AS codes, first, second, coalesce(voters, 0) AS voters, CASE WHEN total > 0 THEN a / total ELSE 0 END AS consensus, CASE WHEN total > 0 THEN (a - b) / total ELSE 0 END AS margin, c_mktsegment, c_name FROM x LEFT JOIN f ON f.k = x.k JOIN customer ON c_custkey = x.k),
    z AS (SELECT *, round(CASE WHEN len(codes) > 0 THEN 0.3 ELSE 0 END + CASE WHEN upper(c_mktsegment) <> 'BUILDING' THEN 0.2 ELSE 0 END + CASE WHEN c_name LIKE '%7%' OR c_name LIKE '%42%' THEN 0.15 ELSE 0 END
        + CASE WHEN voters >= 4 THEN 0.15 ELSE 0 END + CASE WHEN consensus >= 0.7 AND margin >= 0.15 THEN 0.2 ELSE 0 END, 3) AS confidence FROM y)
    SELECT k AS subject, first AS consensus_top, second AS runner_up, voters, votes, round(consensus, 5) AS consensus, round(margin, 5) AS margin, array_to_string(codes, ',') AS codes, CAST(confidence AS DOUBLE) AS confidence,
        CASE WHEN first IS NULL OR confidence < 0.5 THEN 3 WHEN confidence >= 0.85 AND margin >= 0.15 THEN 1 ELSE 2 END AS tier FROM z""")
def identity_bundle(spark: SparkSession, d: str) -> DataFrame:
    """What each customer is taken for by the latest vote of each source, how clearly, with other evidence, and where that routes it."""
    c = F.col
    orders = table(spark, d, "orders").select(
        c("o_custkey").alias("k"), "o_orderpriority", "o_orderdate", "o_orderkey", (c("o_totalprice") / 500000).alias("confidence"),
        F.when(c("o_orderkey") % 11 != 0, F.concat("o_orderstatus", (c("o_orderkey") % 4).cast("string"))).alias("label"),
        F.concat(F.when(c("o_orderkey") % 3 == 0, F.lower("o_orderstatus")).otherwise(c("o_orderstatus")), F.lit("S-"), (c("o_orderkey") % 1200).cast("string")).alias("code"),
    )
    fused = evidence.fuse_votes(orders, ["k"], "o_orderpriority", "label", "confidence", [F.desc("o_orderdate"), F.desc("o_orderkey")], _WEIGHTS, other=1.0)
    # A document's codes, as few as it has pages.
    codes = orders.groupBy("k").agg(evidence.strong_codes(F.collect_set("code")).alias("codes"))
    named = table(spark, d, "customer").select(c("c_custkey").alias("k"), evidence.telling_titles(F.array("c_mktsegment"), ["BUILDING"]).alias("titles"), evidence.signals(c("c_name"), [("7", "seven"), ("42", "answer")]).alias("signals"))
    rows = fused.join(codes, "k").join(named, "k")
    confidence = evidence.identity_confidence(c("codes"), c("titles"), c("signals"), F.when(c("voters") >= 4, 1.0), c("consensus"), c("margin"))
    rows = rows.withColumn("confidence", confidence)
    return rows.select(
        c("k").alias("subject"), c("first").alias("consensus_top"), c("second").alias("runner_up"), c("voters").cast("bigint").alias("voters"), "votes", F.round("consensus", 5).alias("consensus"),
        F.round("margin", 5).alias("margin"), F.array_join("codes", ",").alias("codes"), "confidence", documents.routing_tier(c("confidence"), c("first"), c("margin")).alias("tier"),
    )


@query("""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, i - 1 AS line, xs[i] AS x, coalesce(list_sum(list_transform(xs[1 : i - 1], lambda y: length(y) + 1)), 0) AS start FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM x)),
    p AS (SELECT doc_id, line, start, length(x) AS size, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) AS plain FROM l),
    n AS (SELECT * FROM p WHERE plain <> ''),
    q AS (SELECT doc_id, trim(regexp_replace(replace(plain, 'an', 'n'), '\\s+', ' ', 'g')) AS quote FROM n WHERE length(plain) BETWEEN 20 AND 120 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line DESC) = 1),
    t AS (SELECT q.doc_id, quote, line, start, size, levenshtein(plain, quote) AS e FROM q JOIN n ON n.doc_id = q.doc_id AND abs(length(plain) - length(quote)) <= floor(length(quote) * 0.15::DOUBLE)),
    f AS (SELECT * FROM t WHERE e <= floor(length(quote) * 0.15::DOUBLE) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY e, line) = 1)
    SELECT q.doc_id, coalesce(line, -1) AS line, CAST(coalesce(start, -1) AS BIGINT) AS start, coalesce(size, -1) AS size, coalesce(e, -1) AS distance, CASE WHEN line IS NULL THEN 'ungrounded' WHEN e = 0 THEN 'exact' ELSE 'approximate' END AS grounded FROM q LEFT JOIN f USING (doc_id)""")
def row_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Where in each whole text a damaged quote of one of its lines stands: line, characters and edits, or nowhere."""
    c = F.col
    lines = evidence.text_lines(table(spark, d, "documents"), "doc_id", "text")
    last = first_of(lines.where(F.length("plain").between(20, 120)), ["doc_id"], [F.desc("line")])
    quotes = last.select("doc_id", F.lit(0).alias("row"), F.regexp_replace("plain", "an", "n").alias("quote"))
    found = evidence.locate_lines(quotes, lines, "doc_id", "row", "quote")
    rows = quotes.select("doc_id").join(found.drop("row"), "doc_id", "left")
    kind = F.when(c("line").isNull(), "ungrounded").when(c("distance") == 0, "exact").otherwise("approximate")
    whole = lambda n: F.coalesce(c(n).cast("bigint"), F.lit(-1)).alias(n)
    return rows.select("doc_id", whole("line"), whole("start"), whole("size"), whole("distance"), kind.alias("grounded"))


def page_signals(docs: DataFrame) -> DataFrame:
    """Lines of texts as pages, with the signals that sections are built from."""
    c = F.col
    words = c("words")
    of_length = lambda n: F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) == n)))
    share = lambda pattern: F.size(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))) / F.greatest(F.size(words), F.lit(1))
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\n", -1)).alias("page", "line"))
    # A column of its own: each use of an expression inside functions over arrays would be split anew.
    lines = lines.withColumn("words", F.split("line", r"[^\p{L}]+"))
    return lines.select(
        "doc_id", "page", F.when(c("page") % 9 < 6, "tariff").otherwise("procedural").alias("kind"), of_length(7).alias("leaves"), of_length(8).alias("codes"),
        (F.length("line") % 3 == 0).alias("header"), (F.length("line") % 4 == 0).alias("heading"), c("line").contains(":").alias("effective"), c("line").contains(";").alias("redline"),
        (F.length("line") < 12).alias("toc"), c("line").rlike("[0-9$]").alias("values"), share("[a-z]{9,}").alias("tariff"), share(r"\d").alias("procedural"),
    )


@query()
def section_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Sections of every whole text, its lines taken as pages. Where a section ends depends on what it holds, which SQL cannot
    express; the tests hold it against a plain loop."""
    found = build_sections(page_signals(table(spark, d, "documents")), "doc_id")
    return found.withColumns({"leaves": F.array_join("leaves", ","), "codes": F.array_join("codes", ",")})


@query("""WITH d AS (SELECT o_orderkey AS document, o_custkey AS family, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS start, 'p' || o_custkey || '-' || o_orderkey % 6 AS path FROM orders),
    v AS (SELECT o_orderkey + 1000000 AS version, o_custkey AS family, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS document, o_orderkey % 2 = 0 AS settled FROM orders WHERE o_orderkey % 4 <> 0),
    k AS (SELECT path, max(start) AS one FROM d GROUP BY 1 HAVING count(DISTINCT start) = 1)
    SELECT 'no_version_link' AS kind, CAST(document AS VARCHAR) AS document, NULL AS version, family, start, path FROM d WHERE start IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v WHERE v.document = d.document)
    UNION ALL SELECT 'no_effective_start', CAST(document AS VARCHAR), NULL, family, one, path FROM d JOIN k USING (path) WHERE start IS NULL
        AND NOT EXISTS (SELECT 1 FROM v WHERE v.family = d.family AND v.start = one AND v.document IS NOT NULL)
        AND (NOT EXISTS (SELECT 1 FROM v WHERE v.family = d.family AND v.start = one) OR 1 = (SELECT count(*) FROM v WHERE v.family = d.family AND v.start = one AND v.document IS NULL))
    UNION ALL SELECT 'version_no_doc', NULL, CAST(version AS VARCHAR), family, start, NULL FROM v WHERE document IS NULL AND NOT settled""")
def family_lineage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Dated documents without a version, undated ones whose date their path tells, and versions without a document."""
    c = F.col
    orders, day = table(spark, d, "orders"), F.to_date("o_orderdate").cast("string")
    docs = orders.select(
        c("o_orderkey").alias("document"), c("o_custkey").alias("family"), F.when(c("o_orderkey") % 7 != 0, day).alias("start"),
        F.concat(F.lit("p"), c("o_custkey").cast("string"), F.lit("-"), (c("o_orderkey") % 6).cast("string")).alias("path"),
    )
    versions = orders.where(c("o_orderkey") % 4 != 0).select(
        (c("o_orderkey") + 1000000).alias("version"), c("o_custkey").alias("family"), day.alias("start"), F.when(c("o_orderkey") % 5 != 0, c("o_orderkey")).alias("document"), (c("o_orderkey") % 2 == 0).alias("settled")
    )
    gaps = lineage_gaps(docs, versions)
    return gaps.withColumns({n: c(n).cast("string") for n in ("document", "version")})
