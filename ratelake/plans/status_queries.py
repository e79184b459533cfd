"""Queries that give families, documents, queue rows and addresses their statuses, issues and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratelake.operators import statuses

from .registry import query, table

#: An order stands for a family and its lines for versions, records, documents and runs.
_FACTS_SQL = """WITH f AS (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s, count(l_orderkey) AS versions, count(*) FILTER (l_returnflag = 'R') AS charged, count(*) FILTER (l_returnflag <> 'R') AS zero,
        count(*) FILTER (l_discount >= 0.03) AS found, count(*) FILTER (l_discount >= 0.06) AS down, count(DISTINCT CASE WHEN l_discount >= 0.06 THEN l_suppkey % 3 END) AS files, count(*) FILTER (l_linestatus = 'O') AS docs,
        count(*) FILTER (l_linestatus = 'O' AND l_quantity >= 25) AS bound, count(*) FILTER (l_tax >= 0.07) AS weak, count(*) FILTER (l_tax < 0.01) AS empty, count(*) FILTER (l_quantity < 3) AS skipped, count(*) FILTER (l_tax BETWEEN 0.02 AND 0.05) AS links
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda holds: F.sum(F.when(holds, 1).otherwise(0))
    c = F.col
    per = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("versions"), n(c("l_returnflag") == "R").alias("charged_versions"), n(c("l_returnflag") != "R").alias("zero_charge_versions"),
        n(c("l_discount") >= 0.03).alias("discoveries"), n(c("l_discount") >= 0.06).alias("downloads"),
        F.count_distinct(F.when(c("l_discount") >= 0.06, c("l_suppkey") % 3)).alias("distinct_files"), n(c("l_linestatus") == "O").alias("documents"),
        n((c("l_linestatus") == "O") & (c("l_quantity") >= 25)).alias("bounded_documents"), n(c("l_tax") >= 0.07).alias("weak_runs"),
        n(c("l_tax") < 0.01).alias("empty_runs"), n(c("l_quantity") < 3).alias("skipped_runs"), n(c("l_tax").between(0.02, 0.05)).alias("schedule_links"),
    )
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").join(per, "o_orderkey", "left").withColumn("charges", statuses.count("charged_versions"))


@query(f"""{_FACTS_SQL}, r AS (SELECT s, max(charged) > 0 AS ok FROM f WHERE p = '1-URGENT' GROUP BY 1)
    SELECT o_orderkey, CASE WHEN p = '5-LOW' THEN CASE WHEN coalesce(ok, false) THEN 'legacy_duplicate_family' ELSE 'legacy_family_without_canonical_replacement' END
        WHEN charged = 0 THEN CASE found WHEN 0 THEN 'missing_from_discovery' ELSE 'versions_present_but_no_charges' END WHEN links = 0 THEN 'charged_but_unlinked_to_residential_schedules'
        WHEN zero + weak + empty + skipped > 0 THEN 'charged_with_residual_parse_debt' WHEN docs > 0 AND bound = 0 THEN 'charged_but_unbounded_history' ELSE 'healthy_canonical_candidate' END AS status
    FROM f LEFT JOIN r USING (s)""")
def storm_family_status(spark: SparkSession, d: str) -> DataFrame:
    """How far each storm rider family has come; families of the old form by whether their successors are charged."""
    facts = _facts(spark, d)
    successors = facts.where("o_orderpriority = '1-URGENT'").groupBy("o_orderstatus").agg((F.max("charged_versions") > 0).alias("ok"))
    status = statuses.storm_family_status(F.col("o_orderpriority") == "5-LOW", F.coalesce("ok", F.lit(False)))
    return facts.join(successors, "o_orderstatus", "left").select("o_orderkey", status.alias("status"))


_COMPLIANCE = """CASE WHEN found = 0 THEN 'missing_from_discovery' WHEN down > 0 AND docs = 0 THEN CASE WHEN files < down THEN 'downloaded_duplicate_candidates' ELSE 'downloaded_not_imported' END
        WHEN docs > 0 AND bound = 0 THEN 'imported_but_unbounded' WHEN bound > 0 AND charged = 0 THEN 'bounded_but_zero_charge' WHEN charged > 0 AND zero + weak + empty + skipped > 0 THEN 'bounded_but_partial' ELSE 'healthy' END"""


@query(f"""{_FACTS_SQL}, x AS (SELECT o_orderkey, {_COMPLIANCE} AS status FROM f)
    SELECT *, CASE status WHEN 'missing_from_discovery' THEN 'authenticated_dragnet_search' WHEN 'downloaded_duplicate_candidates' THEN 'deduplicate_then_import_bundle' WHEN 'downloaded_not_imported' THEN 'import_discovered_bundle'
        WHEN 'imported_but_unbounded' THEN 'mine_bundle_page_spans' WHEN 'bounded_but_zero_charge' THEN 'reparse_existing_bundle_spans' WHEN 'bounded_but_partial' THEN 'audit_bundle_quality_and_reparse' ELSE 'none' END AS action FROM x""")
def compliance_bundle_status(spark: SparkSession, d: str) -> DataFrame:
    """How far the filings of each family have come, and what is to be done."""
    rows = _facts(spark, d).select("o_orderkey", statuses.compliance_bundle_status().alias("status"))
    return rows.withColumn("action", statuses.action_for(F.col("status")))


_CLASS = {"1-URGENT": "core_billing_schedule", "2-HIGH": "lighting_schedule", "3-MEDIUM": "ev_or_pilot_schedule", "4-NOT SPECIFIED": "program_or_terms"}


@query(f"""{_FACTS_SQL}, k AS (SELECT *, CASE p {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CLASS.items())} ELSE 'legacy_or_malformed_family' END AS class, s = 'F' AS inside FROM f)
    SELECT class, CASE WHEN class LIKE 'legacy%' THEN 'legacy_duplicate_or_needs_reclassification' WHEN versions = 0 THEN 'no_versions' WHEN charged = 0 THEN 'versions_present_but_no_charges'
        WHEN inside THEN 'covered_and_populated' WHEN class = 'core_billing_schedule' THEN 'missing_from_matrix_but_db_populated' WHEN class IN ('ev_or_pilot_schedule', 'lighting_schedule') THEN 'out_of_scope_but_db_populated'
        ELSE 'out_of_scope_reference_family' END AS status, count(*) AS n FROM k GROUP BY 1, 2""")
def schedule_inventory_status(spark: SparkSession, d: str) -> DataFrame:
    """Families by class and by whether they are tracked."""
    kind = F.lit("legacy_or_malformed_family")
    for priority, name in _CLASS.items():
        kind = F.when(F.col("o_orderpriority") == priority, name).otherwise(kind)
    rows = _facts(spark, d).withColumn("class", kind)
    status = statuses.schedule_inventory_status(F.col("class"), F.col("o_orderstatus") == "F")
    return rows.groupBy("class", status.alias("status")).agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y, o_orderpriority IN ('1-URGENT', '3-MEDIUM') AS stored, o_orderpriority IN ('1-URGENT', '2-HIGH') AS corrected, o_orderstatus <> 'O' AS charged FROM orders)
    SELECT o_orderkey, CASE WHEN corrected AND charged AND EXISTS (SELECT 1 FROM v c WHERE c.o_custkey = v.o_custkey AND c.y = v.y AND NOT c.corrected AND c.charged) THEN 'prefer_clean_companion_version' WHEN corrected AND charged THEN 'review_parsed_redline_version'
        WHEN corrected THEN 'leave_redline_unparsed_or_find_clean_companion' WHEN stored THEN 'refresh_stale_false_positive_fingerprint' ELSE 'likely_ok' END AS status,
        CASE WHEN corrected AND charged AND EXISTS (SELECT 1 FROM v c WHERE c.o_custkey = v.o_custkey AND c.y = v.y AND NOT c.corrected AND c.charged) THEN 95 WHEN corrected AND charged THEN 100 WHEN corrected THEN 30 WHEN stored AND charged THEN 70 WHEN stored THEN 40 ELSE 0 END AS score FROM v""")
def redline_parse_status(spark: SparkSession, d: str) -> DataFrame:
    """Parsed sources that are or were taken for redlines, by whether a clean version of the family and year is charged."""
    c = F.col
    versions = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), c("o_orderpriority").isin("1-URGENT", "3-MEDIUM").alias("stored"),
        c("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("corrected"), (c("o_orderstatus") != "O").alias("charged"),
    )
    clean = versions.groupBy("o_custkey", "y").agg(F.max(~c("corrected") & c("charged")).alias("has_clean"))
    status, points = statuses.redline_status(c("charged"), c("stored"), c("corrected"), c("has_clean"))
    return versions.join(clean, ["o_custkey", "y"]).select("o_orderkey", status.alias("status"), points.alias("score"))


@query("""WITH l AS (SELECT o_orderkey, count(*) FILTER (l_discount >= 0.09) AS clue, count(*) FILTER (l_tax >= 0.08) AS act, count(*) FILTER (l_returnflag = 'A' AND l_tax < 0.02) AS unpaired, count(*) FILTER (l_linestatus = 'F' AND l_tax < 0.03) AS super,
        count(*) FILTER (l_quantity > 45) AS phrase, count(*) FILTER (l_quantity < 10) AS gaps, count(*) FILTER (l_discount < 0.02) * 4 AS odd, o_totalprice / 4000 AS confidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice),
    a AS (SELECT *, greatest(clue, act) AS clues, CASE WHEN unpaired > 0 AND greatest(clue, act) > 0 THEN 'use_redline_clues_to_find_clean_companions' WHEN unpaired > 0 THEN 'link_redlines_to_clean_companions' WHEN greatest(clue, act) > 0 AND odd + gaps > 0 THEN 'compare_redlines_against_clean_versions'
        WHEN confidence >= 80 THEN 'redline_corroboration_only' ELSE 'monitor_redline_family' END AS action FROM l),
    p AS (SELECT o_orderkey, action, 20 * clues + 15 * unpaired + 8 * super + 5 * phrase + least(20, 2 * gaps) + least(15, odd) + CASE action WHEN 'use_redline_clues_to_find_clean_companions' THEN 20 WHEN 'link_redlines_to_clean_companions' THEN 10 ELSE 0 END AS priority FROM a)
    SELECT o_orderkey, action, CAST(priority AS BIGINT) AS priority, CASE WHEN priority >= 80 THEN 'high' WHEN priority >= 35 THEN 'medium' ELSE 'low' END AS band FROM p""")
def redline_lead_priority(spark: SparkSession, d: str) -> DataFrame:
    """What the redlines of each family are good for and how much they matter."""
    c = F.col
    n = lambda holds: F.sum(F.when(holds, 1).otherwise(0))
    lines = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(
        n(c("l_discount") >= 0.09).alias("clue_documents"), n(c("l_tax") >= 0.08).alias("actionable_clues"), n((c("l_returnflag") == "A") & (c("l_tax") < 0.02)).alias("unpaired_redlines"),
        n((c("l_linestatus") == "F") & (c("l_tax") < 0.03)).alias("supersession_clues"), n(c("l_quantity") > 45).alias("comparative_phrases"),
        n(c("l_quantity") < 10).alias("gaps"), (n(c("l_discount") < 0.02) * 4).alias("anomalies"),
    )
    rows = table(spark, d, "orders").select("o_orderkey", (c("o_totalprice") / 4000).alias("confidence")).join(lines, "o_orderkey")
    action, priority, level = statuses.redline_lead_priority()
    return rows.select("o_orderkey", action.alias("action"), priority.cast("bigint").alias("priority"), level.alias("band"))


@query("""WITH l AS (SELECT l_orderkey, list_sort(coalesce(list(DISTINCT year(l_shipdate)) FILTER (l_returnflag = 'A'), [])) AS split, list_sort(coalesce(list(DISTINCT year(l_shipdate)) FILTER (l_linestatus = 'F' AND l_returnflag = 'A'), [])) AS known,
        CAST(sum(l_linenumber * 3 + l_suppkey) % 9 AS DOUBLE) / 4 - 1 AS latest, CAST(sum(l_partkey) % 7 AS DOUBLE) / 4 - 1 AS prorated, min(CAST(l_shipdate AS DATE)) AS best, max(CAST(l_shipdate AS DATE)) AS last, min(l_linenumber) AS k, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN len(split) > 0 THEN CASE WHEN split = known THEN 'bill_split_matches_db_effective_dates' ELSE 'bill_split_not_in_db' END WHEN abs(latest) <= 0.25 THEN 'latest_effective_date_matches_bill'
        WHEN abs(prorated) + 0.25 < abs(latest) THEN 'mid_bill_proration_improves_match' WHEN best <> last THEN 'different_effective_date_fits_better' WHEN n % 2 = 1 THEN 'fixed_charge_needs_proration_review' ELSE 'needs_review' END AS assessment FROM l""")
def rider_date_assessment(spark: SparkSession, d: str) -> DataFrame:
    """How the dates by which each bill splits its riders fit the dates on record."""
    c = F.col
    years = lambda holds: F.array_sort(F.collect_set(F.when(holds, F.year("l_shipdate"))))
    quarter = lambda total, n: (total % n).cast("double") / 4 - 1
    bills = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        years(c("l_returnflag") == "A").alias("split"), years((c("l_linestatus") == "F") & (c("l_returnflag") == "A")).alias("known"),
        quarter(F.sum(c("l_linenumber") * 3 + c("l_suppkey")), 9).alias("latest"), quarter(F.sum("l_partkey"), 7).alias("prorated"),
        F.min(F.to_date("l_shipdate")).alias("best"), F.max(F.to_date("l_shipdate")).alias("last"), (F.count("*") % 2 == 1).alias("fixed"),
    )
    said = statuses.rider_date_assessment(c("split"), c("known"), c("latest"), c("prorated"), c("best"), c("last"), c("fixed"))
    return bills.select("l_orderkey", said.alias("assessment"))


@query("""WITH l AS (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s, o_custkey, count(l_orderkey) FILTER (l_discount >= 0.05) AS versions, count(l_orderkey) FILTER (l_returnflag = 'R') AS charges, count(l_orderkey) FILTER (l_tax < 0.01) AS gaps FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4),
    q AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'skipped' ELSE 'strong' END AS quality, CASE o_custkey % 3 WHEN 0 THEN 'hash' WHEN 1 THEN 'path' END AS via FROM l),
    i AS (SELECT o_orderkey, list_filter([CASE WHEN p = '5-LOW' THEN 'missing_tariff_family' END, CASE WHEN s = 'P' THEN 'missing_effective_start' END, CASE WHEN versions = 0 THEN 'missing_version_link' END, CASE WHEN versions > 0 AND quality IS NULL THEN 'not_processed' END,
            CASE WHEN versions > 0 AND quality <> 'skipped' AND charges = 0 THEN 'linked_without_charges' END], lambda x: x IS NOT NULL) AS b,
        list_filter([CASE WHEN p = '4-NOT SPECIFIED' THEN 'provisional_family' END, CASE WHEN versions > 0 AND gaps > 0 THEN 'version_provenance_gap' END, CASE WHEN via IS NULL THEN 'missing_discovery_match' END, CASE WHEN via = 'path' THEN 'path_only_discovery_link' END], lambda x: x IS NOT NULL) AS w FROM q)
    SELECT o_orderkey, array_to_string(b, ',') AS blocking, array_to_string(w, ',') AS warning, CASE WHEN len(b) > 0 THEN 'blocking' WHEN len(w) > 0 THEN 'warning_only' ELSE 'clean' END AS class FROM i""")
def lineage_issues(spark: SparkSession, d: str) -> DataFrame:
    """The five blocking and four warning issues of each document."""
    c = F.col
    n = lambda holds: F.sum(F.when(holds, 1).otherwise(0))
    lines = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(n(c("l_discount") >= 0.05).alias("versions"), n(c("l_returnflag") == "R").alias("charges"), n(c("l_tax") < 0.01).alias("gaps"))
    rows = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    quality = F.when(c("o_orderkey") % 4 == 1, "skipped").when(c("o_orderkey") % 4 > 1, "strong")
    via = F.when(c("o_custkey") % 3 == 0, "hash").when(c("o_custkey") % 3 == 1, "path")
    blocking, warning = statuses.lineage_issues(
        c("o_orderpriority") != "5-LOW", c("o_orderpriority") == "4-NOT SPECIFIED", c("o_orderstatus") != "P", statuses.count("versions"), quality, statuses.count("charges"), statuses.count("gaps"), via
    )
    out = rows.select("o_orderkey", blocking.alias("b"), warning.alias("w"))
    return out.select("o_orderkey", F.array_join("b", ",").alias("blocking"), F.array_join("w", ",").alias("warning"), statuses.lineage_class(c("b"), c("w")).alias("class"))


@query("""WITH r AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS span, max(event_id) FILTER (event_type = 'view') AS page, max(event_id) FILTER (event_type = 'click') AS parser, max(event_id) FILTER (event_type = 'purchase') AS ocr FROM events GROUP BY 1),
    v AS (SELECT user_id, CASE WHEN page IS NOT NULL THEN 'p' || page % 3 END AS page, CASE WHEN ocr IS NOT NULL THEN 'o' || ocr % 3 END AS ocr, 's' || length(span) % 3 AS span, CASE WHEN parser IS NOT NULL THEN 'h' || parser % 3 END AS parser, user_id % 2 = 0 AS scanned, user_id % 5 > 0 AS dated FROM r),
    a AS (SELECT user_id, dated, list_filter([CASE WHEN page IS NULL THEN 'page_artifact_missing' END, CASE WHEN page <> 'p1' THEN 'page_artifact_version' END, CASE WHEN page IS NOT NULL AND scanned AND ocr IS DISTINCT FROM 'o1' THEN 'ocr_backend_version' END,
            CASE WHEN page IS NOT NULL AND scanned AND ocr IS DISTINCT FROM 'o2' THEN 'ocr_normalization_version' END, CASE WHEN span <> 's1' THEN 'span_artifact_version' END, CASE WHEN parser IS NULL THEN 'parser_run_missing' END, CASE WHEN parser <> 'h1' THEN 'parser_version' END], lambda x: x IS NOT NULL) AS x FROM v),
    b AS (SELECT user_id, CASE WHEN NOT dated AND len(list_filter(x, lambda y: y NOT LIKE '%missing')) = 0 THEN [] ELSE x END AS x FROM a)
    SELECT user_id, array_to_string(x, ',') AS reasons, CASE WHEN list_contains(x, 'ocr_backend_version') THEN 95 WHEN list_contains(x, 'ocr_normalization_version') THEN 92 WHEN list_contains(x, 'parser_version') THEN 90 WHEN list_contains(x, 'page_artifact_missing') THEN 85 ELSE 60 END AS priority FROM b WHERE len(x) > 0""")
def stale_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a stage that is missing or of another version, why, and how urgent."""
    c = F.col
    last = lambda kind: F.max(F.when(c("event_type") == kind, c("event_id")))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("span"), last("view").alias("page"), last("click").alias("parser"), last("purchase").alias("ocr"))
    named = rows.select(
        "user_id", F.concat(F.lit("p"), c("page") % 3).alias("page_version"), F.concat(F.lit("o"), c("ocr") % 3).alias("ocr_version"), F.concat(F.lit("o"), c("ocr") % 3).alias("normalization_version"),
        F.concat(F.lit("s"), F.length("span") % 3).alias("span_version"), F.concat(F.lit("h"), c("parser") % 3).alias("parser_version"),
    )
    reasons, priority = statuses.staleness({"page": "p1", "ocr": "o1", "normalization": "o2", "span": "s1", "parser": "h1"}, c("user_id") % 2 == 0, c("user_id") % 5 > 0)
    return named.select("user_id", F.array_join(reasons, ",").alias("reasons"), priority.alias("priority")).where("priority IS NOT NULL")


@query("""WITH x AS (SELECT c_custkey, list_filter([CASE WHEN c_mktsegment = 'BUILDING' THEN 'latest_parser_profile' END, CASE WHEN c_nationkey = 7 THEN 'family_key' END, CASE WHEN c_nationkey < 5 THEN 'family_prefix' END, CASE WHEN c_acctbal > 9000 THEN 'candidate_profile' END,
        CASE WHEN c_acctbal < -900 THEN 'candidate_reason' END, CASE WHEN c_custkey % 11 = 0 THEN 'signal_match' END, CASE WHEN c_custkey % 13 = 0 THEN 'company' END], lambda v: v IS NOT NULL) AS r FROM customer)
    SELECT c_custkey, array_to_string(r, ',') AS reasons, list_max(list_transform(r, lambda v: CASE v WHEN 'candidate_reason' THEN 93 WHEN 'candidate_profile' THEN 91 WHEN 'latest_parser_profile' THEN 90 WHEN 'family_key' THEN 88 WHEN 'signal_match' THEN 87 WHEN 'family_prefix' THEN 85 ELSE 82 END)) AS priority FROM x WHERE len(r) > 0""")
def profile_impact(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a change of a parser profile touches, why, and how urgent."""
    c = F.col
    reasons = statuses.held(
        [
            (c("c_mktsegment") == "BUILDING", "latest_parser_profile"), (c("c_nationkey") == 7, "family_key"), (c("c_nationkey") < 5, "family_prefix"), (c("c_acctbal") > 9000, "candidate_profile"),
            (c("c_acctbal") < -900, "candidate_reason"), (c("c_custkey") % 11 == 0, "signal_match"), (c("c_custkey") % 13 == 0, "company"),
        ]
    )
    rows = table(spark, d, "customer").select("c_custkey", reasons.alias("r"))
    return rows.select("c_custkey", F.array_join("r", ",").alias("reasons"), statuses.profile_impact(c("r")).alias("priority")).where("priority IS NOT NULL")


@query("""WITH e AS (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
    q AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'stale_stage:x' WHEN 1 THEN 'profile_dependency:y' WHEN 2 THEN 'needs_review' ELSE 'manual' END AS reason, CASE WHEN k <= 2 THEN CASE event_type WHEN 'view' THEN 'strong' WHEN 'click' THEN 'empty' END END AS quality,
        CASE WHEN k = 3 THEN 'empty' END AS attempt, value < 1 AS bare, value > 99 AS old, CASE event_id % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' END AS ocr, user_id % 2 = 0 AS linked, CAST(event_id % 50 AS INTEGER) AS p, event_id % 3 > 0 AS dated FROM e),
    c AS (SELECT *, CASE WHEN quality = 'empty' OR attempt = 'empty' OR bare THEN 'empty_parse' WHEN old OR ocr = 'pending' THEN 'ocr_needed' WHEN reason LIKE 'stale_stage%' THEN 'stale_stage' WHEN reason LIKE 'profile_dependency%' THEN 'profile_impact' WHEN quality = 'strong' AND NOT linked THEN 'strong_but_unlinked' WHEN reason = 'needs_review' THEN 'needs_review' ELSE 'other' END AS category FROM q)
    SELECT event_id, category, CASE category WHEN 'empty_parse' THEN 500 WHEN 'ocr_needed' THEN 450 WHEN 'stale_stage' THEN 400 WHEN 'profile_impact' THEN 300 WHEN 'strong_but_unlinked' THEN 200 WHEN 'needs_review' THEN 150 ELSE 100 END + p
        + CASE WHEN dated THEN 15 ELSE 0 END + CASE WHEN quality = 'strong' THEN 10 ELSE 0 END + CASE WHEN ocr = 'pending' THEN 5 ELSE 0 END AS rank_score FROM c""")
def reprocess_priority(spark: SparkSession, d: str) -> DataFrame:
    """Category and rank of each row in the queue."""
    c = F.col
    latest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, d, "events").withColumn("k", F.row_number().over(latest))
    kind = c("event_id") % 4
    reason = F.when(kind == 0, "stale_stage:x").when(kind == 1, "profile_dependency:y").when(kind == 2, "needs_review").otherwise("manual")
    quality = F.when((c("k") <= 2) & (c("event_type") == "view"), "strong").when((c("k") <= 2) & (c("event_type") == "click"), "empty")
    ocr = F.when(c("event_id") % 10 == 0, "pending").when(c("event_id") % 10 == 1, "done")
    category, rank = statuses.reprocess_priority(
        reason, quality, F.when(c("k") == 3, "empty"), c("value") < 1, c("value") > 99, ocr, c("user_id") % 2 == 0, (c("event_id") % 50).cast("int"), c("event_id") % 3 > 0
    )
    return rows.select("event_id", category.alias("category"), rank.alias("rank_score"))


_OWN, _ARCHIVES, _REGULATORS = ("site1.example.com", "site2.example.org"), ("site3.example.net",), ("site4.example.com",)


@query(f"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1) AS file, page_id % 5 AS k FROM pages),
    s AS (SELECT page_id, CASE WHEN {" OR ".join(f"ends_with(host, '{h}')" for h in _OWN)} THEN 1 ELSE 0 END AS own, CASE WHEN ends_with(host, '{_ARCHIVES[0]}') THEN 1 ELSE 0 END AS arch, CASE WHEN ends_with(host, '{_REGULATORS[0]}') THEN 1 ELSE 0 END AS reg, file, url, k FROM u)
    SELECT page_id, CAST(40 * own + CASE WHEN ends_with(file, '.pdf') THEN 10 ELSE 0 END + CASE WHEN k = 0 THEN 40 WHEN k = 1 THEN 5 ELSE 0 END + CASE WHEN k > 2 AND page_id % 15 > 0 THEN least(25, 5 + 2 * (page_id % 15)) ELSE 0 END + CASE WHEN k = 4 THEN 5 ELSE 0 END AS DOUBLE) AS url_points,
        CAST(CASE WHEN own = 1 THEN 45 WHEN arch = 1 THEN 35 WHEN reg = 1 THEN 40 WHEN url <> '' THEN 20 ELSE 0 END + CASE WHEN file <> '' THEN 12 ELSE 0 END + CASE WHEN k < 2 THEN 20 ELSE 0 END + CASE WHEN k = 2 THEN 18 ELSE 0 END + CASE WHEN k = 3 THEN 10 ELSE 0 END + CASE WHEN k > 0 THEN 8 ELSE 0 END
            + CASE k WHEN 0 THEN 15 WHEN 1 THEN 14 WHEN 2 THEN 10 WHEN 3 THEN 5 ELSE 4 END AS DOUBLE) AS lead_points,
        CAST(CASE WHEN k > 0 THEN 25 ELSE 0 END + CASE WHEN k < 3 THEN 30 ELSE 0 END + CASE WHEN k <> 2 THEN 20 ELSE 0 END + CASE WHEN k = 1 THEN 10 ELSE 0 END + CASE WHEN k > 2 THEN 12 ELSE 0 END AS DOUBLE) AS docket_points FROM s""")
def lead_scores(spark: SparkSession, d: str) -> DataFrame:
    """Points of each address as a candidate, as a historical lead, and of its docket."""
    c = F.col
    rows = table(spark, d, "pages").select(
        "page_id", "url", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).alias("host"), F.regexp_extract("url", r"/([^/?#]*)(?:[?#].*)?$", 1).alias("file"), (c("page_id") % 5).alias("k")
    )
    k = c("k")
    some = lambda holds: F.when(holds, "x")
    status = F.when(k == 1, 404).otherwise(500)
    url = statuses.url_score(c("host"), c("file"), k == 0, status, F.when(k > 2, c("page_id") % 15), some(k == 4), _OWN)
    lead = statuses.lead_score(
        c("url"), c("host"), c("file"), F.lit("leaf 60"), F.when(k < 2, "60").otherwise("77"), F.when(k == 2, "res"), F.lit(None).cast("string"), F.lit("RES"), some(k == 3), some(k > 0),
        F.element_at(F.array(*map(F.lit, statuses.PROVENANCE)), (k + 1).cast("int")), _OWN, _ARCHIVES, _REGULATORS,
    )
    docket = statuses.docket_score(some(k > 0), k < 3, k == 2, some(k == 1), F.when(k > 2, 2).otherwise(0))
    return rows.select("page_id", url.alias("url_points"), lead.alias("lead_points"), docket.alias("docket_points"))


_SIGNALS = (("example", 1.5, True), ("free|offer", -3.0, False), ("the|la|de", 1.0, False), ("[0-9]{4}", 2.0, True))
_COMBOS = ((("the", "[0-9]"), 2.5), (("https?", "page"), 1.0))


@query("""WITH p AS (SELECT page_id, coalesce(url, '') AS url, regexp_extract(coalesce(html, ''), '(?i)<title>([^<]*)', 1) AS title, regexp_extract(coalesce(html, ''), '(?i)<p[^>]*>([^<]*)', 1) AS snippet FROM pages),
    s AS (SELECT *, title || ' ' || snippet AS tx FROM p),
    t AS (SELECT page_id, """ + " + ".join(f"{w} * CASE WHEN regexp_matches(title, '(?i){p}') THEN 2.5 WHEN regexp_matches(snippet, '(?i){p}') THEN 1.0 " + (f"WHEN regexp_matches(url, '(?i){p}') THEN 0.3 " if u else "") + "ELSE 0 END" for p, w, u in _SIGNALS) + " + " + " + ".join(f"CASE WHEN {' AND '.join(f'''regexp_matches(tx, '(?i){p}')''' for p in ps)} THEN {b} ELSE 0 END" for ps, b in _COMBOS) + """
        + least(2.0, 0.5 * (page_id % 6)) + CASE page_id % 4 WHEN 0 THEN 4 WHEN 1 THEN -6 ELSE 0 END + CASE WHEN regexp_matches(url, '(?i)\\.pdf($|\\?)') THEN 1.5 WHEN regexp_matches(url, '(?i)\\.html?($|\\?)') THEN -1.5 ELSE 0 END
        + CASE WHEN page_id % 5 > 1 THEN least(3.0, (page_id % 5 - 1) * 0.8) ELSE 0 END + least(2.0, (page_id % 9) * 0.3) AS x FROM s)
    SELECT page_id, CAST(round(greatest(0, x), 6) AS DOUBLE) AS points FROM t""")
def search_result_scores(spark: SparkSession, d: str) -> DataFrame:
    """Points of each page as a search result: signals by field, combinations, codes, target, file type, repeats."""
    k = F.col("page_id")
    html = F.coalesce("html", F.lit(""))
    rows = table(spark, d, "pages").select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.regexp_extract(html, "(?i)<title>([^<]*)", 1).alias("title"), F.regexp_extract(html, "(?i)<p[^>]*>([^<]*)", 1).alias("snippet")
    )
    target = F.when(k % 4 == 0, True).when(k % 4 == 1, False)
    points = statuses.search_score(F.col("title"), F.col("snippet"), F.col("url"), _SIGNALS, _COMBOS, k % 6, target, k % 5, k % 9)
    return rows.select("page_id", F.round(points, 6).alias("points"))
