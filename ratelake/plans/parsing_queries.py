"""Queries that read dates, times, months, ordinals and codes out of text and check them against what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.functions import parsing
from ratelake.functions.calendar import is_holiday

from .registry import query, table, values


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 3 THEN CAST(date_trunc('month', day) AS DATE) ELSE day END AS VARCHAR) AS day FROM d""")
def date_formats(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in four ways, and words that are no date, read back."""
    day = F.to_date("o_orderdate")
    kind = F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, "MMMM d, yyyy")).when(kind == 2, F.date_format(day, "MMM d, yyyy"))
        .when(kind == 3, F.upper(F.date_format(day, "MMMM yyyy"))).otherwise("upon approval")
    )
    return table(spark, d, "orders").select("o_orderkey", parsing.parse_date(text).cast("string").alias("day"))


_SEASONS = ("July through October", "billing months of November through March", "all calendar months", "winter", "May through May")


@query("""WITH s(words, a, z) AS (VALUES ('July through October', 7, 10), ('billing months of November through March', 11, 3), ('all calendar months', 1, 12), ('winter', NULL, NULL), ('May through May', 5, 5)),
    m AS (SELECT month(o_orderdate) AS m, o_totalprice AS p FROM orders)
    SELECT words, count(*) AS n, count(*) FILTER (CASE WHEN a <= z THEN m BETWEEN a AND z ELSE m >= a OR m <= z END) AS inside FROM s, m GROUP BY 1""")
def month_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Orders in the months that a season's words name, also over the turn of the year."""
    months = table(spark, d, "orders").groupBy(F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    words = values(spark, [(s,) for s in _SEASONS], "words string")
    inside = F.sum(F.when(parsing.month_in(F.col("m"), F.col("words")), F.col("n")).otherwise(0))
    return months.crossJoin(words).groupBy("words").agg(F.sum("n").alias("n"), inside.alias("inside"))


_PERIODS = (
    {"name": "on-peak", "months": ["June through September"], "weekday_hours": "2:00 p.m. to 8:00 p.m."},
    {"name": "on-peak", "months": ["October through May"], "weekday_hours": "6:00 a.m. – 10:00 a.m.; 6:00 p.m. – 9:00 p.m."},
    {"name": "discount", "months": ["all calendar months"], "weekday_hours": "12:00 a.m. (midnight) to 5:00 a.m.", "weekend_hours": "12:00 a.m. to 7:00 a.m."},
    {"name": "off-peak"},
)


@query("""WITH e AS (SELECT user_id, value, month(ts) AS m, hour(ts) * 60 + minute(ts) AS t, CAST(ts AS DATE) AS day, year(ts) AS y FROM events),
    h AS (SELECT y, f.day AS day FROM (SELECT DISTINCT y FROM e), LATERAL (SELECT CASE dayofweek(x) WHEN 6 THEN x - 1 WHEN 0 THEN x + 1 ELSE x END AS day FROM (VALUES (make_date(y, 1, 1)), (make_date(y, 7, 4)), (make_date(y, 12, 25))) v(x)
            UNION ALL SELECT make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER) UNION ALL SELECT make_date(y, 9, 1) + CAST((8 - isodow(make_date(y, 9, 1))) % 7 AS INTEGER) UNION ALL SELECT make_date(y, 11, 1) + CAST((11 - isodow(make_date(y, 11, 1))) % 7 + 21 AS INTEGER)) f),
    x AS (SELECT *, isodow(day) >= 6 OR EXISTS (SELECT 1 FROM h WHERE h.y = e.y AND h.day = e.day) AS free FROM e)
    SELECT user_id, CASE WHEN NOT free AND m BETWEEN 6 AND 9 AND t >= 840 AND t < 1200 THEN 'on-peak' WHEN NOT free AND (m >= 10 OR m <= 5) AND (t >= 360 AND t < 600 OR t >= 1080 AND t < 1260) THEN 'on-peak'
        WHEN NOT free AND t < 300 OR free AND t < 420 THEN 'discount' ELSE 'off-peak' END AS period, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY 1, 2""")
def interval_table_periods(spark: SparkSession, d: str) -> DataFrame:
    """Usage by the periods of a table written in words: the first with hours that fit, else off-peak."""
    day = F.to_date("ts")
    period = parsing.period_from_table(F.month("ts"), F.hour("ts") * 60 + F.minute("ts"), (F.weekday(day) >= 5) | is_holiday(day), _PERIODS)
    return table(spark, d, "events").groupBy("user_id", period.alias("period")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT o_orderkey, CAST(o_orderkey % 40 AS INTEGER) AS ordinal, CAST(o_custkey % 700 AS VARCHAR) AS leaf FROM orders""")
def revision_labels(spark: SparkSession, d: str) -> DataFrame:
    """Revision numbers and leaves written as labels (Thirty-First Revised Leaf No. 60) and read back."""
    words = sorted((n, w) for w, n in parsing.ordinal_words().items() if n < 40)
    word = F.element_at(F.array(*(F.lit(w) for _, w in words)), (F.col("o_orderkey") % 40 + 1).cast("int"))
    label = F.concat(F.initcap(word), F.when(F.col("o_orderkey") % 40 > 0, " Revised").otherwise(""), F.lit(" LEAF No. "), F.col("o_custkey") % 700)
    return table(spark, d, "orders").select("o_orderkey", parsing.revision_ordinal(label).alias("ordinal"), parsing.leaf_number(label).alias("leaf"))


_CODE = r"[A-Za-z]{2,5}-[0-9]{1,4}|\$[0-9]+\.[0-9]{2}|[0-9]{3}-[0-9]{4}"


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '{_CODE}'), lambda x: upper(x)))), ' ') AS codes FROM documents""")
def code_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Codes and amounts in each whole text, each once, sorted."""
    return table(spark, d, "documents").select("doc_id", F.array_join(parsing.codes(F.coalesce("text", F.lit("")), _CODE), " ").alias("codes"))


_GROUPS = {"ECONOMY": "standard", "ECONOMY ANODIZED": "premium", "LARGE": "bulk", "LARGE BRUSHED": "premium", "PROMO": "offer", "STANDARD POLISHED": "premium", "STANDARD": "standard", "SMALL": "retail"}


@query(f"""WITH g(code, grp) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _GROUPS.items())}),
    p AS (SELECT p_partkey, replace(upper(p_type), '-', '_') AS t FROM part)
    SELECT p_partkey, coalesce(arg_max(grp, length(code)), 'unknown') AS grp FROM p LEFT JOIN g ON starts_with(t, code) GROUP BY 1""")
def code_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of each code: its own, else that of the longest known beginning."""
    return table(spark, d, "part").select("p_partkey", parsing.schedule_group(F.col("p_type"), _GROUPS).alias("grp"))


@query("""SELECT s_suppkey, CASE WHEN regexp_matches(s_name, '(?i)#0*[0-9]*[13579]$') THEN 'Odd Power' WHEN regexp_matches(s_name, '(?i)supplier') THEN 'Even Power' ELSE 'other' END AS company FROM supplier""")
def company_names(spark: SparkSession, d: str) -> DataFrame:
    """Free text mapped to one name for each company, first pattern first."""
    names = [("#0*[0-9]*[13579]$", "Odd Power"), ("SUPPLIER", "Even Power")]
    return table(spark, d, "supplier").select("s_suppkey", parsing.canonical_company(F.col("s_name"), names, "other").alias("company"))


@query("""WITH t AS (SELECT doc_id, list_distinct(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+')) AS w FROM documents), b AS (SELECT item_id, list_distinct(string_split_regex(lower(text), '[^a-z0-9]+')) AS x FROM benchmark)
    SELECT doc_id, item_id, CAST(least(30, 1.5 * len(list_intersect(list_filter(w, lambda v: v <> ''), x))) AS DOUBLE) AS points FROM t JOIN b ON doc_id % (SELECT max(item_id) + 1 FROM benchmark) = item_id""")
def token_points(spark: SparkSession, d: str) -> DataFrame:
    """Points for the words that a text and its assigned item have in common, up to a cap."""
    tokens = lambda c: F.filter(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")), lambda x: x != "")
    items = table(spark, d, "benchmark").select("item_id", tokens(F.col("text")).alias("x"))
    n = items.agg(F.max("item_id") + 1).first()[0] or 1
    docs = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("w"), (F.col("doc_id") % n).alias("item_id"))
    return docs.join(items, "item_id").select("doc_id", "item_id", parsing.overlap_points(F.col("w"), F.col("x"), 30.0, 1.5).alias("points"))


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(CASE WHEN o_orderkey % 2 = 1 THEN month(o_orderdate) ELSE 0 END AS INTEGER) AS month, upper(left(o_orderpriority, 1)) AS sector,
        count(*) AS n, round(sum(CASE WHEN o_orderkey % 7 > 0 THEN round(o_totalprice, 2) END), 2) AS price FROM orders GROUP BY 1, 2, 3""")
def record_normaliser(spark: SparkSession, d: str) -> DataFrame:
    """Raw records of text fields (period, sector, price, some of them empty or words) read into typed columns; yearly ones have month 0."""
    raw = table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy")).alias("period"),
        F.lower(F.substring("o_orderpriority", 1, 1)).alias("sectorid"),
        F.when(F.col("o_orderkey") % 7 > 0, F.round("o_totalprice", 2).cast("string")).when(F.col("o_orderkey") % 2 == 0, "").otherwise("NA").alias("price"),
    )
    year, month = parsing.leading_digits_period(F.col("period"))
    typed = raw.select(year.alias("year"), F.coalesce(month, F.lit(0)).alias("month"), F.upper("sectorid").alias("sector"), parsing.number_or_null(F.col("price")).alias("price"))
    return typed.groupBy("year", "month", "sector").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))
