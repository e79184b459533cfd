"""Reports: work lists, coverage, validation, regional prices, spans and sections, flags and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratelake.functions import parsing
from ratelake.operators import documents, statuses
from ratelake.operators.latest import first_of, top_of, union_all
from ratelake.operators.ranks import rank_in

from .registry import query, table, values


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT event_id, user_id, value AS confidence FROM l WHERE k = 1 AND value < 50 AND user_id % 3 > 0""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Attempts whose latest outcome still needs review; order them by confidence, the newest first among equals."""
    latest = first_of(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return latest.where("value < 50 AND user_id % 3 > 0").select("event_id", "user_id", F.col("value").alias("confidence"))


@query("""WITH l AS (SELECT *, CASE WHEN value < 30 THEN 'needs_review' WHEN value < 60 THEN 'corrected' WHEN value < 70 THEN 'rejected' ELSE 'accepted' END AS outcome, event_id % 4 = 0 AS human FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1),
    s AS (SELECT event_type AS profile, count(*) AS attempts, count(*) FILTER (outcome = 'needs_review') AS needs_review, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'corrected') AS corrected, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (human) AS human_reviewed FROM l GROUP BY 1)
    SELECT *, CAST(row_number() OVER (ORDER BY corrected + rejected + needs_review DESC, human_reviewed DESC, profile DESC) AS INTEGER) AS rank FROM s""")
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    """Latest outcomes by parser profile, those with most to mend first."""
    v = F.col("value")
    outcome = F.when(v < 30, "needs_review").when(v < 60, "corrected").when(v < 70, "rejected").otherwise("accepted")
    latest = first_of(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "event_type", "day"], [F.desc("ts"), F.desc("event_id")])
    n = lambda name: F.count(F.when(F.col("outcome") == name, 1)).alias(name)
    rows = latest.withColumn("outcome", outcome).groupBy(F.col("event_type").alias("profile")).agg(
        F.count("*").alias("attempts"), *map(n, ("needs_review", "accepted", "corrected", "rejected")), F.count(F.when(F.col("event_id") % 4 == 0, 1)).alias("human_reviewed")
    )
    order = Window.orderBy(F.desc(F.col("corrected") + F.col("rejected") + F.col("needs_review")), F.desc("human_reviewed"), F.desc("profile"))
    return rows.withColumn("rank", F.row_number().over(order))  # one row for each profile


@query("""WITH s AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS useful, count(*) > 18 AS retired FROM orders GROUP BY 1),
    q AS (SELECT c_custkey, (c_custkey % 10 + 1) * (1 + coalesce(useful, 0)) AS p, coalesce(retired, false) AS r FROM customer LEFT JOIN s ON o_custkey = c_custkey)
    SELECT c_custkey, round(CAST(p AS DOUBLE), 6) AS priority FROM q WHERE NOT r""")
def query_usefulness(spark: SparkSession, d: str) -> DataFrame:
    """Queries by priority times one plus what they have been useful for; retired ones are left out."""
    stats = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("useful"), (F.count("*") > 18).alias("retired"))
    rows = table(spark, d, "customer").join(stats, "c_custkey", "left").where(~F.coalesce("retired", F.lit(False)))
    return rows.select("c_custkey", F.round((F.col("c_custkey") % 10 + 1) * (1 + F.coalesce("useful", F.lit(0.0))), 6).alias("priority"))


@query("""WITH d AS (SELECT c_custkey, list_distinct([c_nationkey, (c_nationkey + 3) % 25]) AS leaves, c_mktsegment AS code, list_distinct(string_split(lower(c_mktsegment || ' power rate ' || (c_custkey % 4)), ' ')) AS w FROM customer),
    f AS (SELECT s_suppkey, s_nationkey AS leaf, CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'NONE' END AS code, list_distinct(string_split('rate power ' || (s_suppkey % 4) || ' service', ' ')) AS v FROM supplier),
    s AS (SELECT c_custkey, s_suppkey, CASE WHEN list_contains(leaves, leaf) THEN 100 ELSE 0 END + CASE WHEN d.code = f.code THEN 80 ELSE 0 END + CASE WHEN len(list_intersect(w, v)) >= 2 THEN least(20, 4 * len(list_intersect(w, v))) ELSE 0 END AS score FROM d, f)
    SELECT c_custkey, s_suppkey, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey) AS INTEGER) AS rank FROM s WHERE score >= 80 QUALIFY rank <= 3""")
def family_link_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """The three likeliest families of each document by leaf, code and words of the title."""
    c = F.col
    words = lambda *parts: F.array_distinct(F.split(F.lower(F.concat(*parts)), " "))
    docs = table(spark, d, "customer").select(
        "c_custkey", F.array_distinct(F.array(c("c_nationkey"), (c("c_nationkey") + 3) % 25)).cast("array<string>").alias("leaves"), F.array("c_mktsegment").alias("codes"),
        words("c_mktsegment", F.lit(" power rate "), c("c_custkey") % 4).alias("words"),
    )
    code = F.when(c("s_suppkey") % 3 == 0, "BUILDING").when(c("s_suppkey") % 3 == 1, "MACHINERY").otherwise("NONE")
    families = table(spark, d, "supplier").select("s_suppkey", F.array(c("s_nationkey").cast("string")).alias("leaves"), F.array(code).alias("codes"), words(F.lit("rate power "), c("s_suppkey") % 4, F.lit(" service")).alias("words"))
    return documents.family_links(docs, families, "c_custkey", "s_suppkey", top=3).select("c_custkey", "s_suppkey", "score", "rank")


@query("""SELECT o_custkey, count(*) AS n_missing, min(o_orderkey) AS first_order FROM orders o WHERE o_orderdate IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1""")
def missing_versions(spark: SparkSession, d: str) -> DataFrame:
    """Dated documents without a version, by family."""
    linked = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = table(spark, d, "orders").where("o_orderdate IS NOT NULL").join(linked, "o_orderkey", "left_anti")
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n_missing"), F.min("o_orderkey").alias("first_order"))


@query("""SELECT e.user_id, count(*) AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey * 2 = e.event_id OR o_custkey * 7 = e.event_id) GROUP BY 1""")
def unmatched_either_key(spark: SparkSession, d: str) -> DataFrame:
    """Rows that match neither by one key nor by the other: two anti-joins, as an OR in a join would pair everything."""
    orders = table(spark, d, "orders")
    one, two = orders.select((F.col("o_orderkey") * 2).alias("event_id")), orders.select((F.col("o_custkey") * 7).alias("event_id"))
    return table(spark, d, "events").join(one, "event_id", "left_anti").join(two, "event_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT event_id, user_id FROM events a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_id > a.event_id AND b.value >= a.value)""")
def not_superseded(spark: SparkSession, d: str) -> DataFrame:
    """Rows that no later row of their key reaches: the later maximum tells, without comparing pairs."""
    later = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    rows = table(spark, d, "events").withColumn("later", F.max("value").over(later))
    return rows.where("later IS NULL OR later < value").select("event_id", "user_id")


@query("""WITH p(prefix, kind) AS (VALUES ('ECONOMY', 'a'), ('ECONOMY B', 'b'), ('STANDARD', 'c'), ('PROMO', 'd'))
    SELECT prefix, kind, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part JOIN p ON p_type LIKE prefix || '%' GROUP BY 1, 2""")
def prefix_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows by all known prefixes of their code: one key for each length of prefix, joined by equality."""
    rows = [("ECONOMY", "a"), ("ECONOMY B", "b"), ("STANDARD", "c"), ("PROMO", "d")]
    known = values(spark, rows, "prefix string, kind string")
    heads = F.explode(F.array_distinct(F.array(*(F.substring("p_type", 1, n) for n in sorted({len(p) for p, _ in rows}))))).alias("prefix")
    found = table(spark, d, "part").select("p_retailprice", heads).join(known, "prefix")
    return found.groupBy("prefix", "kind").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("""SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS INTEGER) AS place FROM documents WHERE length(text) >= 50 AND source IS NOT NULL QUALIFY place <= 10""")
def candidates_after_filter(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of each language among texts of 50 characters: filtered before they are counted off, so none is lost."""
    rows = table(spark, d, "documents").where((F.length("text") >= 50) & F.col("source").isNotNull())
    return top_of(rows.withColumn("size", F.length("text")), ["lang"], [F.desc("size"), "doc_id"], 10, "place").select("lang", "doc_id", "place")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 10000 - 1 AS cents, l_linenumber = 1 AND l_returnflag = 'R' AS total, l_linenumber = 2 AND l_returnflag = 'A' AS sub FROM lineitem)
    SELECT l_orderkey, count(*) FILTER (NOT total AND NOT sub AND abs(cents) <= 5) AS n, round(coalesce(sum(cents) FILTER (NOT total AND NOT sub AND abs(cents) <= 5), 0), 6) AS cents, count(*) FILTER (total AND abs(cents) <= 10) AS totals FROM l GROUP BY 1
    HAVING abs(coalesce(sum(cents) FILTER (NOT total AND NOT sub AND abs(cents) <= 5), 0)) <= 10""")
def rider_line_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Rider lines without totals, subtotals and rates too large to be one; blocks whose sum is too large go."""
    c = F.col
    rows = table(spark, d, "lineitem").select("l_orderkey", (c("l_extendedprice") / 10000 - 1).alias("cents"), ((c("l_linenumber") == 1) & (c("l_returnflag") == "R")).alias("total"), ((c("l_linenumber") == 2) & (c("l_returnflag") == "A")).alias("sub"))
    line = ~c("total") & ~c("sub") & (F.abs("cents") <= 5)
    sums = rows.groupBy("l_orderkey").agg(F.count(F.when(line, 1)).alias("n"), F.coalesce(F.sum(F.when(line, c("cents"))), F.lit(0.0)).alias("s"), F.count(F.when(c("total") & (F.abs("cents") <= 10), 1)).alias("totals"))
    return sums.where(F.abs("s") <= 10).select("l_orderkey", "n", F.round("s", 6).alias("cents"), "totals")


@query("""WITH r AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 20 AS rate, value AS cents FROM events)
    SELECT event_id, round(rate, 6) AS rate FROM r WHERE rate < 0.5 AND NOT cents > 50""")
def plausible_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates read from JSON that may be one: below half a dollar and not over fifty cents a kWh."""
    rate = F.get_json_object("props", "$.k").try_cast("double") / 20
    return table(spark, d, "events").where((rate < 0.5) & ~(F.col("value") > 50)).select("event_id", F.round(rate, 6).alias("rate"))


@query("""WITH b AS (SELECT 'A' AS utility, o_custkey AS k, CAST(o_orderdate AS DATE) AS day, o_totalprice / 10000 AS base, CASE WHEN o_orderstatus = 'F' THEN 0.5 END AS rider FROM orders WHERE o_orderpriority < '3'
        UNION ALL SELECT 'B', o_custkey, CAST(o_orderdate AS DATE), o_totalprice / 10000, NULL FROM orders WHERE o_orderpriority >= '3')
    SELECT utility, k, CAST(day AS VARCHAR) AS day, CASE WHEN rider IS NULL THEN 'base_only' ELSE 'base_plus_riders' END AS coverage, CASE WHEN rider IS NULL THEN 'base' ELSE 'all_in' END AS metric, round(base + coalesce(rider, 0), 6) AS value FROM b""")
def regional_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two utilities' timelines in one form: the all-in price where riders are known, else the base price."""
    c = F.col
    rows = table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.to_date("o_orderdate").cast("string").alias("day"), (c("o_totalprice") / 10000).alias("base"), F.when(c("o_orderstatus") == "F", 0.5).alias("rider"))
    one = rows.where("o_orderpriority < '3'").select(F.lit("A").alias("utility"), c("o_custkey").alias("k"), "day", "base", "rider")
    two = rows.where("o_orderpriority >= '3'").select(F.lit("B").alias("utility"), c("o_custkey").alias("k"), "day", "base")
    both = union_all(one, two).withColumn("coverage", F.when(c("rider").isNull(), "base_only").otherwise("base_plus_riders"))
    metric = F.when(c("coverage") == "base_plus_riders", F.struct(F.lit("all_in").alias("metric"), (c("base") + c("rider")).alias("value"))).otherwise(F.struct(F.lit("base").alias("metric"), c("base").alias("value")))
    return both.select("utility", "k", "day", "coverage", metric.alias("m")).select("utility", "k", "day", "coverage", "m.metric", F.round("m.value", 6).alias("value"))


_PLACES = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_SALES_SQL = f"SELECT n_name AS state, r_name AS region, CAST(year(o_orderdate) AS INTEGER) AS year, sum(l_quantity) AS kwh, sum(l_extendedprice) AS revenue, count(DISTINCT c_custkey) AS customers FROM {_PLACES} GROUP BY 1, 2, 3"


def _sales(spark: SparkSession, d: str) -> DataFrame:
    """Yearly sales, revenue and customers of each place."""
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("n_name").alias("state"), F.col("r_name").alias("region"), F.year("o_orderdate").alias("year")).agg(F.sum("l_quantity").alias("kwh"), F.sum("l_extendedprice").alias("revenue"), F.countDistinct("c_custkey").alias("customers"))


@query(f"SELECT state, region, CASE WHEN region IN ('AMERICA', 'EUROPE') THEN 'restructured' ELSE 'regulated' END AS market, year, round(revenue / kwh, 4) AS price, round(kwh, 2) AS kwh, customers FROM ({_SALES_SQL}) WHERE year BETWEEN 1995 AND 1999")
def price_history(spark: SparkSession, d: str) -> DataFrame:
    """Yearly prices of each place with its region and market."""
    market = F.when(F.col("region").isin("AMERICA", "EUROPE"), "restructured").otherwise("regulated")
    rows = _sales(spark, d).where("year BETWEEN 1995 AND 1999")
    return rows.select("state", "region", market.alias("market"), "year", F.round(F.col("revenue") / F.col("kwh"), 4).alias("price"), F.round("kwh", 2).alias("kwh"), "customers")


@query(f"""WITH s AS ({_SALES_SQL}), n AS (SELECT year, sum(revenue) / sum(kwh) AS p FROM s GROUP BY 1)
    SELECT state, s.year, round(revenue / kwh, 4) AS price, round(p, 4) AS average, round(revenue / kwh - p, 4) AS delta, round((revenue / kwh - p) / p * 100, 4) AS pct FROM s JOIN n ON n.year = s.year WHERE state IN ('FRANCE', 'BRAZIL', 'CHINA', 'NATION_1', 'NATION_7') AND s.year >= 1996""")
def selected_states(spark: SparkSession, d: str) -> DataFrame:
    """Prices of a chosen list of places since a year against the average of all."""
    rows = _sales(spark, d)
    whole = rows.groupBy("year").agg((F.sum("revenue") / F.sum("kwh")).alias("p"))
    price, p = F.col("revenue") / F.col("kwh"), F.col("p")
    some = rows.where(F.col("state").isin("FRANCE", "BRAZIL", "CHINA", "NATION_1", "NATION_7") & (F.col("year") >= 1996)).join(whole, "year")
    return some.select("state", "year", F.round(price, 4).alias("price"), F.round(p, 4).alias("average"), F.round(price - p, 4).alias("delta"), F.round((price - p) / p * 100, 4).alias("pct"))


_FUELS = {"gas": "A", "coal": "N", "hydro": "R"}


@query(f"""WITH m AS (SELECT n_name AS state, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, sum(l_quantity) AS total, {", ".join(f"sum(CASE WHEN l_returnflag = '{v}' THEN l_quantity ELSE 0 END) AS {k}" for k, v in _FUELS.items())} FROM {_PLACES} GROUP BY 1, 2, 3)
    SELECT state, year, month, total, {", ".join(f"coalesce(round({k} / nullif(total, 0), 4), 0) AS share_{k}" for k in _FUELS)} FROM m""")
def monthly_fuel_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of each kind in the month's total of each place."""
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    sums = rows.groupBy(F.col("n_name").alias("state"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        F.sum("l_quantity").alias("total"), *(F.sum(F.when(F.col("l_returnflag") == v, F.col("l_quantity")).otherwise(0.0)).alias(k) for k, v in _FUELS.items())
    )
    return sums.select("state", "year", "month", "total", *(F.coalesce(F.round(F.col(k) / F.nullif(F.col("total"), F.lit(0.0)), 4), F.lit(0.0)).alias(f"share_{k}") for k in _FUELS))


@query(f"""WITH s AS ({_SALES_SQL}), g AS (SELECT n_name AS state, CAST(year(o_orderdate) AS INTEGER) AS year, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS gas FROM {_PLACES} GROUP BY 1, 2)
    SELECT s.state, s.year, round(revenue / kwh, 4) AS price, round(gas, 4) AS share_gas FROM s JOIN g ON g.state = s.state AND g.year = s.year""")
def price_vs_fuel_mix(spark: SparkSession, d: str) -> DataFrame:
    """Price and share of one kind for each place and year."""
    mix = monthly_fuel_shares_by_year(spark, d)
    return _sales(spark, d).join(mix, ["state", "year"]).select("state", "year", F.round(F.col("revenue") / F.col("kwh"), 4).alias("price"), F.round("gas", 4).alias("share_gas"))


def monthly_fuel_shares_by_year(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    share = F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")
    return rows.groupBy(F.col("n_name").alias("state"), F.year("o_orderdate").alias("year")).agg(share.alias("gas"))


@query(f"""WITH s AS ({_SALES_SQL}), t AS (SELECT n_name AS state, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS reported FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT state, year, round(reported / kwh, 4) AS reported, round(revenue / kwh, 4) AS implied, round((reported - revenue) / kwh, 4) AS delta FROM s JOIN t USING (state, year)""")
def revenue_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """The reported price of each place and year against the one that revenue and sales imply."""
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    told = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_name").alias("state"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("told"))
    price = lambda total: F.round(total / F.col("kwh"), 4)
    both = _sales(spark, d).join(told, ["state", "year"])
    return both.select("state", "year", price(F.col("told")).alias("reported"), price(F.col("revenue")).alias("implied"), price(F.col("told") - F.col("revenue")).alias("delta"))


@query("""WITH v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders),
    t AS (SELECT o_orderkey, o_custkey, o_totalprice FROM v WHERE k = 1), l AS (SELECT o_custkey, CASE l_returnflag WHEN 'A' THEN 'Base' WHEN 'N' THEN 'Fuel' ELSE 'Storm' END AS component, sum(l_extendedprice) AS amount FROM t JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
    r AS (SELECT t.o_custkey, o_totalprice - coalesce(sum(amount), 0) AS rest FROM t LEFT JOIN l USING (o_custkey) GROUP BY t.o_custkey, o_totalprice)
    SELECT o_custkey, component, round(amount, 2) AS amount FROM l UNION ALL SELECT o_custkey, 'Residual', round(rest, 2) FROM r WHERE abs(rest) > 0.005""")
def bill_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each customer's latest bill, and as a residual what no part explains."""
    latest = first_of(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey", "o_custkey", "o_totalprice")
    glossary = values(spark, [("A", "Base"), ("N", "Fuel"), ("R", "Storm")], "l_returnflag string, component string")
    lines = latest.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(glossary, "l_returnflag")
    parts = lines.groupBy("o_custkey", "component").agg(F.sum("l_extendedprice").alias("amount"))
    told = parts.groupBy("o_custkey").agg(F.sum("amount").alias("told"))
    rest = latest.join(told, "o_custkey", "left").select("o_custkey", F.lit("Residual").alias("component"), (F.col("o_totalprice") - F.coalesce("told", F.lit(0.0))).alias("amount")).where("abs(amount) > 0.005")
    return parts.unionByName(rest).select("o_custkey", "component", F.round("amount", 2).alias("amount"))


@query("""WITH v AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS s FROM orders),
    a AS (SELECT o_custkey, count(*) AS n, count(DISTINCT day) AS days, count(*) FILTER (s = 'F') AS covered FROM v GROUP BY 1)
    SELECT CASE WHEN n > days THEN 'duplicate_dates' WHEN covered = 0 THEN 'no_coverage' WHEN covered < n THEN 'partial_coverage' ELSE 'covered' END AS finding, count(*) AS families, CAST(sum(n) AS BIGINT) AS versions, round(sum(covered) * 100.0 / sum(n), 4) AS pct FROM a GROUP BY 1""")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    """Families by what is wrong with their history first: dates told twice, riders missing for all or for some dates."""
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("o_orderdate")).alias("days"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("covered"))
    finding = statuses.first_of_rules([(F.col("n") > F.col("days"), "duplicate_dates"), (F.col("covered") == 0, "no_coverage"), (F.col("covered") < F.col("n"), "partial_coverage")], "covered")
    return per.groupBy(finding.alias("finding")).agg(F.count("*").alias("families"), F.sum("n").alias("versions"), F.round(F.sum("covered") * 100.0 / F.sum("n"), 4).alias("pct"))


_RECORDS = "SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS superseded_by FROM events"


@query(f"SELECT event_id, coalesce(superseded_by, 0) AS superseded_by, CASE WHEN superseded_by IS NULL THEN 1 ELSE 0 END AS current FROM ({_RECORDS})")
def classification_records(spark: SparkSession, d: str) -> DataFrame:
    """Every classification with the one that replaced it; the last of a subject and stage is current."""
    rows = documents.supersede(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id")
    return rows.select("event_id", F.coalesce("superseded_by", F.lit(0)).alias("superseded_by"), F.col("superseded_by").isNull().cast("int").alias("current"))


def _points_sql(markers: tuple, column: str) -> str:
    return " + ".join(f"CASE WHEN regexp_matches({column}, '(?i){p}') THEN {w} ELSE 0 END" for p, w in markers)


_FINAL = (("order", 4), ("commission", 3), (r"[0-9]{3}-[0-9]{4}", 2), *documents.FINAL)
_PROPOSED = (("license", 3), ("free", 3), *documents.PROPOSED)


@query(f"""WITH p AS (SELECT doc_id, {_points_sql(_FINAL, "coalesce(text, '')")} AS f, {_points_sql(_PROPOSED, "coalesce(text, '')")} AS p, {_points_sql((("[*%#$&]{3}", 4), ("[A-Z]{4,}", 1)), "coalesce(text, '')")} AS r FROM documents)
    SELECT doc_id, CASE WHEN f > p THEN 'true' WHEN p > 0 THEN 'false' ELSE 'unknown' END AS is_final, CASE WHEN f > p THEN 'false' WHEN p > 0 THEN 'true' ELSE 'unknown' END AS is_proposed, CASE WHEN r >= 4 THEN 'true' WHEN r >= 1 THEN 'false' ELSE 'unknown' END AS is_redline,
        round(least(1.0, greatest(f, p) / 15), 6) AS confidence FROM p""")
def document_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether each whole text is final, proposed, or a redline, by weighted marks of each."""
    text = F.coalesce("text", F.lit(""))
    points = table(spark, d, "documents").select("doc_id", documents.marker_points(text, _FINAL).alias("f"), documents.marker_points(text, _PROPOSED).alias("p"), documents.marker_points(text, (("[*%#$&]{3}", 4), ("[A-Z]{4,}", 1))).alias("r"))
    f, p = F.col("f"), F.col("p")
    final = documents.final_flag(f, p)
    opposite = F.when(final == "true", "false").when(final == "false", "true").otherwise("unknown")
    return points.select("doc_id", final.alias("is_final"), opposite.alias("is_proposed"), documents.redline_flag(F.col("r")).alias("is_redline"), F.round(F.least(F.lit(1.0), F.greatest(f, p) / 15), 6).alias("confidence"))


@query("""WITH b AS (SELECT c_custkey, (c_acctbal + 1000) / 11000 AS confidence, CASE WHEN c_custkey % 6 > 0 THEN c_mktsegment END AS top, c_custkey % 30 / 100.0 AS margin, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'BUILDING' END AS cur FROM customer),
    t AS (SELECT *, CASE WHEN top IS NULL OR confidence < 0.5 THEN 3 WHEN confidence >= 0.85 AND margin >= 0.15 THEN 1 ELSE 2 END AS tier FROM b)
    SELECT tier, CASE WHEN top IS NULL THEN 'no_consensus' WHEN top = 'MACHINERY' THEN 'refused_unsafe' ELSE 'proposed' END AS status, CASE WHEN top IS NULL OR cur IS NULL THEN 'unknown' WHEN cur = top THEN 'agrees' ELSE 'differs' END AS agreement, count(*) AS n FROM t GROUP BY 1, 2, 3""")
def routing_and_binding(spark: SparkSession, d: str) -> DataFrame:
    """Documents by routing tier, by what their consensus profile may be bound to, and by whether that is what they have."""
    c = F.col
    rows = table(spark, d, "customer").select(
        ((c("c_acctbal") + 1000) / 11000).alias("confidence"), F.when(c("c_custkey") % 6 > 0, c("c_mktsegment")).alias("top"), (c("c_custkey") % 30 / 100.0).alias("margin"),
        F.when(c("c_custkey") % 3 == 0, c("c_mktsegment")).when(c("c_custkey") % 3 == 1, "BUILDING").alias("cur"),
    )
    status, agrees = documents.binding(c("top"), c("top") != "MACHINERY", c("cur"))
    agreement = F.when(agrees.isNull(), "unknown").when(agrees, "agrees").otherwise("differs")
    return rows.groupBy(documents.routing_tier(c("confidence"), c("top"), c("margin")).alias("tier"), status.alias("status"), agreement.alias("agreement")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT conv_id, turn, role, turn + CASE WHEN length(text) > 300 THEN 1 ELSE 0 END AS z FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(text) DESC NULLS LAST, role, text) = 1),
    g AS (SELECT *, CASE WHEN lag(role) OVER w = role AND lag(z) OVER w >= turn - 1 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM g)
    SELECT conv_id, CAST(section AS BIGINT) AS section, role, min(turn) AS start_page, max(z) AS end_page, count(*) AS spans FROM n GROUP BY 1, 2, 3""")
def section_merging(spark: SparkSession, d: str) -> DataFrame:
    """Spans, the widest of each place, with touching neighbours of one kind put together."""
    turns = table(spark, d, "conversations")
    widest = first_of(turns, ["conv_id", "turn"], [F.length("text").desc_nulls_last(), "role", "text"])
    spans = widest.select("conv_id", "role", F.col("turn").alias("start_page"), (F.col("turn") + F.when(F.length("text") > 300, 1).otherwise(0)).alias("end_page"))
    return documents.merge_neighbours(spans, "conv_id", "role")


@query()
def span_segmentation(spark: SparkSession, d: str) -> DataFrame:
    """Spans of neighbouring pages about one subject. What a span holds decides where it ends, which SQL cannot express;
    the tests hold it against a plain loop."""
    turns = first_of(table(spark, d, "conversations"), ["conv_id", "turn"], ["role", "text"])
    text = F.coalesce("text", F.lit(""))
    pages = turns.select(
        "conv_id", F.col("turn").alias("page"), F.when(F.col("role") == "assistant", "tariff").when(F.col("role") == "user", "procedural").otherwise("unknown").alias("doc_type"),
        parsing.codes(text, r"\b[a-z]{9,}\b").alias("leaves"), F.when(F.length(text) % 5 == 0, F.array("role")).otherwise(F.array().cast("array<string>")).alias("titles"),
    )
    return documents.segment_pages(pages, "conv_id").select("conv_id", "span", "start_page", "end_page", "doc_type", F.array_join("leaves", ",").alias("leaves"), F.array_join("titles", ",").alias("titles"))


@query("""WITH r AS (SELECT o_custkey, CASE o_orderstatus WHEN 'P' THEN 'zero_charges' WHEN 'O' THEN 'none_active' ELSE 'fine' END AS gap, count(*) AS n FROM orders GROUP BY 1, 2),
    a AS (SELECT o_custkey, CAST(coalesce(sum(n) FILTER (gap = 'zero_charges'), 0) AS BIGINT) AS z, CAST(coalesce(sum(n) FILTER (gap = 'none_active'), 0) AS BIGINT) AS m FROM r GROUP BY 1)
    SELECT o_custkey, CASE WHEN z > 0 AND m > 0 THEN 'reparse_then_search' WHEN z > 0 THEN 'reparse_zero_charge_versions' ELSE 'search_missing_versions' END AS repair, 10 * z + 12 * m + CASE WHEN z > 0 AND m > 0 THEN 6 ELSE 0 END AS priority,
        CAST(row_number() OVER (PARTITION BY CASE WHEN z > 0 AND m > 0 THEN 'reparse_then_search' WHEN z > 0 THEN 'reparse_zero_charge_versions' ELSE 'search_missing_versions' END ORDER BY 10 * z + 12 * m DESC, o_custkey) AS INTEGER) AS place FROM a WHERE z + m > 0""")
def rider_repair_plan(spark: SparkSession, d: str) -> DataFrame:
    """From gaps to a queue to a plan: what mends each family's riders, in the order of what is missing."""
    c = F.col
    gaps = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.when(c("o_orderstatus") == "P", 1)).alias("z"), F.count(F.when(c("o_orderstatus") == "O", 1)).alias("m"))
    queue = gaps.where("z + m > 0").withColumn("repair", statuses.first_of_rules([((c("z") > 0) & (c("m") > 0), "reparse_then_search"), (c("z") > 0, "reparse_zero_charge_versions")], "search_missing_versions"))
    queue = queue.withColumn("weight", c("z") * 10 + c("m") * 12)
    ranked = rank_in(queue, ["repair"], [F.desc("weight"), c("o_custkey")])
    return ranked.select("o_custkey", "repair", (c("weight") + F.when((c("z") > 0) & (c("m") > 0), 6).otherwise(0)).alias("priority"), c("place").cast("int").alias("place"))


@query("""WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(lower(text), ' ') END AS w FROM documents),
    c AS (SELECT doc_id, len(list_filter(w, lambda x: length(x) <= 3)) AS short, len(list_filter(w, lambda x: length(x) BETWEEN 4 AND 7)) AS medium, len(list_filter(w, lambda x: length(x) > 7)) AS long FROM w)
    SELECT doc_id, CASE WHEN short >= greatest(medium, long) THEN 'short' WHEN medium >= long THEN 'medium' ELSE 'long' END AS top, greatest(short, medium, long) AS n FROM c""")
def score_map_winner(spark: SparkSession, d: str) -> DataFrame:
    """A map of scores for each text and its winner, the first of equals."""
    words = F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split(F.lower("text"), " "))
    n = lambda low, high: F.size(F.filter(words, lambda x: F.length(x).between(low, high))).cast("bigint")
    scores = F.create_map(F.lit("short"), n(0, 3), F.lit("medium"), n(4, 7), F.lit("long"), n(8, 2**31 - 1))
    rows = table(spark, d, "documents").select("doc_id", scores.alias("scores"))
    most = F.array_max(F.map_values("scores"))
    winner = F.element_at(F.map_keys(F.map_filter("scores", lambda k, v: v == most)), 1)
    return rows.select("doc_id", winner.alias("top"), most.alias("n"))
