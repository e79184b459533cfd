"""Queries about provenance: records of documents, gaps and what fills them, series known when a version began."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.operators.provenance import discovery_match, provenance_gaps, series_coverage
from ratelake.operators.timeline import canonical

from .registry import query, table

_HAS = "({0} IS NOT NULL AND lower(trim({0})) NOT IN ('', 'none', 'null'))"
_MATCH_SQL = f"""WITH d AS (SELECT page_id AS document, CASE WHEN page_id % 5 = 0 THEN 'None' ELSE url END AS path, CASE WHEN page_id % 7 = 0 THEN ' ' ELSE md5(html) END AS hash FROM pages),
    r AS (SELECT page_id AS record, CASE WHEN page_id % 3 <> 0 THEN url END AS path, CASE WHEN page_id % 4 <> 0 THEN md5(html) END AS hash,
        CASE WHEN page_id % 6 = 0 THEN 'null' ELSE 'E-7 Sub ' || page_id % 90 END AS docket, CASE WHEN page_id % 8 <> 0 THEN '2019-0' || (1 + page_id % 9) END AS filed FROM pages),
    p AS (SELECT path, max(record) AS p FROM r WHERE {_HAS.format("path")} GROUP BY 1), h AS (SELECT hash, max(record) AS h FROM r WHERE {_HAS.format("hash")} GROUP BY 1),
    m AS (SELECT d.*, CASE WHEN p IS NOT NULL AND h IS NOT NULL THEN 'path+hash' WHEN h IS NOT NULL THEN 'hash_only' WHEN p IS NOT NULL THEN 'path_only' ELSE 'missing' END AS linkage, r.record, docket AS record_docket, filed AS record_filed
        FROM d LEFT JOIN p ON p.path = d.path AND {_HAS.format("d.path")} LEFT JOIN h ON h.hash = d.hash AND {_HAS.format("d.hash")} LEFT JOIN r ON r.record = coalesce(h, p))"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    """Pages as documents, with blanks, and as the records that found them."""
    c, pages = F.col, table(spark, d, "pages")
    n, digest = c("page_id"), F.md5(c("html").cast("binary"))
    documents = pages.select(n.alias("document"), F.when(n % 5 == 0, "None").otherwise(c("url")).alias("path"), F.when(n % 7 == 0, " ").otherwise(digest).alias("hash"))
    records = pages.select(
        n.alias("record"), F.when(n % 3 != 0, c("url")).alias("path"), F.when(n % 4 != 0, digest).alias("hash"),
        F.when(n % 6 == 0, "null").otherwise(F.concat(F.lit("E-7 Sub "), (n % 90).cast("string"))).alias("docket"),
        F.when(n % 8 != 0, F.concat(F.lit("2019-0"), (1 + n % 9).cast("string"))).alias("filed"),
    )
    return discovery_match(documents, records)


@query(f"{_MATCH_SQL} SELECT document, linkage, CAST(record AS VARCHAR) AS record FROM m")
def discovery_links(spark: SparkSession, d: str) -> DataFrame:
    """How each document is linked to the records that found it, and the record taken."""
    return _matched(spark, d).select("document", "linkage", F.col("record").cast("string").alias("record"))


@query(f"""{_MATCH_SQL}, v AS (SELECT *, CASE WHEN document % 2 = 0 THEN 'E-2' END AS docket_number, CASE WHEN document % 3 = 0 THEN '2020-01-01' ELSE ' none ' END AS order_date,
        CASE WHEN document % 4 = 0 THEN '' ELSE '500' END AS leaf_no, CASE WHEN document % 6 = 0 THEN 'a.pdf' END AS source_pdf, CASE WHEN document % 12 = 0 THEN 'e-2' END AS docket_dir,
        CASE WHEN document % 8 = 0 THEN '503' END AS document_leaf, CASE WHEN {_HAS.format("path")} THEN CASE WHEN document % 9 < 4 THEN 'E-7-Sub-' || document % 9 || '/' ELSE '' END || path END AS spot FROM m),
    x AS (SELECT document, linkage, list_filter([CASE WHEN NOT {_HAS.format("docket_number")} THEN 'docket_number' END, CASE WHEN NOT {_HAS.format("order_date")} THEN 'order_date' END, CASE WHEN NOT {_HAS.format("leaf_no")} THEN 'leaf_no' END, CASE WHEN NOT {_HAS.format("source_pdf")} THEN 'source_pdf' END, CASE WHEN NOT {_HAS.format("docket_dir")} THEN 'docket_dir' END], lambda f: f IS NOT NULL) AS missing,
        list_filter([CASE WHEN {_HAS.format("record_docket")} THEN 'docket_number' END, CASE WHEN {_HAS.format("record_filed")} THEN 'order_date' END, CASE WHEN {_HAS.format("document_leaf")} THEN 'leaf_no' END, CASE WHEN {_HAS.format("spot")} THEN 'source_pdf' END, CASE WHEN regexp_matches(spot, '(?i)e-[0-9]+-sub-[0-9]+') THEN 'docket_dir' END], lambda f: f IS NOT NULL) AS source FROM v)
    SELECT document, linkage, len(missing) AS n_missing, array_to_string(missing, ',') AS missing, array_to_string(list_filter(missing, lambda f: list_contains(source, f)), ',') AS fillable FROM x WHERE len(missing) > 0""")
def provenance_report(spark: SparkSession, d: str) -> DataFrame:
    """Versions that miss fields of provenance, with what their record, document or path can fill."""
    n, path = F.col("document"), F.col("path")
    prefix = F.when(n % 9 < 4, F.concat(F.lit("E-7-Sub-"), (n % 9).cast("string"), F.lit("/"))).otherwise("")
    versions = _matched(spark, d).withColumns({
        "docket_number": F.when(n % 2 == 0, "E-2"), "order_date": F.when(n % 3 == 0, "2020-01-01").otherwise(" none "), "leaf_no": F.when(n % 4 == 0, "").otherwise("500"),
        "source_pdf": F.when(n % 6 == 0, "a.pdf"), "docket_dir": F.when(n % 12 == 0, "e-2"), "document_leaf": F.when(n % 8 == 0, "503"),
        "path": F.when(path != "None", F.concat(prefix, path)),
    })
    gaps = provenance_gaps(versions)
    return gaps.select("document", "linkage", F.size("missing").cast("bigint").alias("n_missing"), F.array_join("missing", ",").alias("missing"), F.array_join("fillable", ",").alias("fillable"))


_EXPECTED = ["RF", "AF", "NO", "NF"]


@query(f"""WITH c AS (SELECT o_custkey AS k, CAST(l_shipdate AS DATE) AS e, l_returnflag || l_linestatus AS code, CASE WHEN l_discount >= 0.05 THEN 'sheet' ELSE 'summary' END AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    s AS (SELECT k, e, list_sort(list_distinct(list(code))) AS codes, list_sort(list_distinct(list(kind))) AS kinds FROM c GROUP BY 1, 2),
    v AS (SELECT o_orderkey, o_custkey AS k, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS start FROM orders),
    m AS (SELECT v.*, e, codes, kinds FROM v ASOF LEFT JOIN s ON v.k = s.k AND v.start >= s.e)
    SELECT o_orderkey, CAST(e AS VARCHAR) AS effective, CASE WHEN e IS NULL THEN 'no_prior_series' WHEN e = start THEN 'same_day' ELSE 'carried_forward' END AS coverage, coalesce(len(codes), 0) AS n_codes,
        array_to_string(list_filter({_EXPECTED}, lambda f: NOT list_contains(coalesce(codes, []), f)), ',') AS missing_codes, coalesce(array_to_string(kinds, ','), '') AS kinds FROM m""")
def rider_series_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The series of codes known when each order's version began, and the expected codes that it lacks."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderpriority") != "5-LOW", F.to_date("o_orderdate")).alias("start"))
    lines = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    components = lines.select("k", F.to_date("l_shipdate").alias("effective"), F.concat("l_returnflag", "l_linestatus").alias("code"), F.when(F.col("l_discount") >= 0.05, "sheet").otherwise("summary").alias("kind"))
    out = series_coverage(orders, components, ["k"], _EXPECTED)
    return out.select("o_orderkey", F.col("effective").cast("string").alias("effective"), "coverage", F.col("n_codes").cast("bigint").alias("n_codes"), F.array_join("missing_codes", ",").alias("missing_codes"), F.array_join("kinds", ",").alias("kinds"))


_CANONICAL_SQL = """SELECT CASE WHEN o_orderpriority < '3' THEN 'A' ELSE 'B' END AS utility, CASE WHEN o_orderpriority < '3' THEN 'RES' ELSE 'RS' END AS schedule, o_orderkey AS source_pdf,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS effective_date, CAST(1000 AS DOUBLE) AS representative_kwh, round(o_totalprice / 10000, 6) AS base_cents_per_kwh,
    CASE WHEN o_orderpriority < '3' THEN round(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 50 ELSE o_totalprice / 60 END, 6) ELSE -1.0 END AS base_bill_amount,
    CASE WHEN o_orderpriority < '3' THEN CASE o_orderstatus WHEN 'F' THEN 'all_in' WHEN 'O' THEN 'base_only' ELSE 'unknown' END ELSE 'unknown' END AS timeline_kind FROM orders"""


@query(_CANONICAL_SQL.replace("o_orderkey AS source_pdf", "CAST(o_orderkey AS VARCHAR) AS source_pdf"))
def canonical_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Two utilities' histories in the common form: one with bills of both seasons and a coverage, one with prices only."""
    c = F.col
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("effective_date"), (c("o_totalprice") / 10000).alias("blended_base_cents_per_kwh"), c("o_orderkey").cast("string").alias("source_pdf"))
    status = F.when(c("o_orderstatus") == "F", "base_plus_riders").when(c("o_orderstatus") == "O", "base_only").otherwise("review")
    one = rows.where("o_orderpriority < '3'").withColumns({"summer_base_bill": F.when(c("o_orderstatus") != "F", c("o_totalprice") / 50), "winter_base_bill": c("o_totalprice") / 60, "bill_coverage_status": status})
    two = rows.where("NOT o_orderpriority < '3'")
    both = canonical(one, "A", "RES").unionByName(canonical(two, "B", "RS"))
    return both.select(
        "utility", "schedule", "source_pdf", c("effective_date").cast("string").alias("effective_date"), "representative_kwh",
        F.round("base_cents_per_kwh", 6).alias("base_cents_per_kwh"), F.coalesce(F.round("base_bill_amount", 6), F.lit(-1.0)).alias("base_bill_amount"), "timeline_kind",
    )
