"""Queries of bill estimates: legacy bills, shared ladders, overrides, prorated riders, rider components, coverage of dockets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratelake.operators.asof import asof_join
from ratelake.operators.compare import reconcile
from ratelake.operators.latest import first_of

from .registry import query, table, values


def in_tier(start: Column, end: Column, low: Column, high: Column) -> Column:
    """What the stretch from ``start`` to ``end`` has between two bounds; without an upper one the tier is open."""
    return F.greatest(F.lit(0.0), F.least(end, F.coalesce(high, end)) - F.greatest(start, low))


@query("""WITH s AS (SELECT o_custkey, o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1998-06-15' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1),
    t AS (SELECT o_custkey, l_linenumber AS k, l_discount AS rate, l_tax AS rider, l_linestatus AS season, sum(l_quantity * 10) OVER w - l_quantity * 10 AS low, sum(l_quantity * 10) OVER w AS high, lead(l_linenumber) OVER w IS NULL AS last FROM s JOIN lineitem ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY l_linenumber, l_partkey, l_suppkey))
    SELECT o_custkey, round(sum(round(greatest(0, (CASE WHEN last THEN 1000 ELSE least(1000, high) END) - low) * rate, 6)), 2) AS energy, round(sum(CASE WHEN season = 'O' THEN rider * 1000 / 100 ELSE 0 END), 2) AS riders, count(*) AS lines FROM t GROUP BY 1""")
def legacy_bill(spark: SparkSession, d: str) -> DataFrame:
    """A bill of 1000 kWh from the segment in effect on a day: its blocks, the last one open, and the riders of the season."""
    day = F.lit("1998-06-15").cast("date")
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), day.alias("at"))
    segments = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("since"))
    chosen = asof_join(asked, segments, ["o_custkey"], "at", "since", ["o_orderkey"], inner=True).select("o_custkey", "o_orderkey")
    lines = chosen.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("o_custkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    width = F.col("l_quantity") * 10
    blocks = lines.withColumns({"high": F.sum(width).over(order), "more": F.lead("l_linenumber").over(order).isNotNull()}).withColumn("low", F.col("high") - width)
    part = in_tier(F.lit(0.0), F.lit(1000.0), F.col("low"), F.when(F.col("more"), F.col("high")))
    rider = F.when(F.col("l_linestatus") == "O", F.col("l_tax") * 1000 / 100).otherwise(0.0)
    return blocks.groupBy("o_custkey").agg(F.round(F.sum(F.round(part * F.col("l_discount"), 6)), 2).alias("energy"), F.round(F.sum(rider), 2).alias("riders"), F.count("*").alias("lines"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER w - l_quantity AS a, sum(l_quantity) OVER w AS z FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
    SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(0.12 * greatest(0, least(z, 40) - a) + 0.1 * greatest(0, least(z, 90) - greatest(a, 40)) + 0.08 * greatest(0, z - greatest(a, 90)) AS DOUBLE), 6) AS amount FROM p""")
def shared_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Split periods of one bill share one ladder of tiers: each begins where those before it ended."""
    upto = F.sum("l_quantity").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    parts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (upto - F.col("l_quantity")).alias("a"), upto.alias("z"))
    tiers = ((0.0, 40.0, 0.12), (40.0, 90.0, 0.1), (90.0, None, 0.08))
    amount = sum((in_tier(F.col("a"), F.col("z"), F.lit(low), F.lit(high).cast("double")) * rate for low, high, rate in tiers), F.lit(0.0))
    return parts.select("l_orderkey", "l_linenumber", "l_partkey", F.round(amount, 6).alias("amount"))


@query("""WITH e AS (SELECT l_orderkey, l_returnflag AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), f AS (SELECT l_orderkey, l_returnflag AS k, max(l_extendedprice) AS v FROM lineitem WHERE l_tax > 0.05 GROUP BY 1, 2),
    m AS (SELECT * FROM f UNION ALL SELECT e.* FROM e ANTI JOIN f USING (l_orderkey, k)), a AS (SELECT l_orderkey, l_returnflag AS k, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1, 2)
    SELECT l_orderkey, k AS component, round(a.v, 4) AS actual, round(m.v, 2) AS estimated, CASE WHEN a.v IS NULL THEN 'estimated_only' WHEN m.v IS NULL THEN 'actual_only' ELSE 'matched' END AS status FROM m FULL JOIN a USING (l_orderkey, k)""")
def reconcile_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Bills against estimates in which what history knows of a component takes the place of the estimate."""
    lines = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "component")
    key = ["l_orderkey", "component"]
    estimated = lines.groupBy(*key).agg(F.sum("l_extendedprice").alias("amount"))
    known = lines.where("l_tax > 0.05").groupBy(*key).agg(F.max("l_extendedprice").alias("amount"))
    merged = known.unionByName(estimated.join(known.select(*key), key, "left_anti"))
    actual = lines.where("l_linenumber <> 2").select(*key, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    both = reconcile(actual, merged, key, "amount")
    return both.select(*key, F.round("actual_amount", 4).alias("actual"), F.round("estimated_amount", 2).alias("estimated"), "status")


@query("""WITH b AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS x, CAST(o_orderdate AS DATE) + 29 AS y, o_totalprice / 100000 AS billed FROM orders),
    r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS a, o_totalprice / 90000 AS rate FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1),
    s AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY o_custkey ORDER BY a) - 1, DATE '2099-12-31') AS z FROM r),
    m AS (SELECT o_orderkey, billed, rate, a, date_diff('day', greatest(a, x), least(z, y)) + 1 AS days FROM b JOIN s ON s.o_custkey = b.o_custkey AND a <= y AND z >= x),
    f AS (SELECT o_orderkey, any_value(billed) AS billed, sum(rate * days) / 30 AS prorated, arg_max(rate, a) AS latest, count(*) AS n FROM m GROUP BY 1)
    SELECT o_orderkey, n, round(CASE WHEN abs(prorated - billed) < abs(latest - billed) THEN prorated ELSE latest END, 6) AS amount, CASE WHEN abs(prorated - billed) < abs(latest - billed) THEN 'prorated' ELSE 'latest' END AS fit FROM f""")
def prorated_rider_fit(spark: SparkSession, d: str) -> DataFrame:
    """A rider by days in each of its rates or at the last of them, whichever fits the bill better."""
    orders = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    bills = orders.select("o_orderkey", "o_custkey", F.col("day").alias("x"), F.date_add("day", 29).alias("y"), (F.col("o_totalprice") / 100000).alias("billed"))
    rates = first_of(orders.where("o_orderstatus = 'F'"), ["o_custkey", "day"], [F.desc("o_orderkey")]).select("o_custkey", F.col("day").alias("a"), (F.col("o_totalprice") / 90000).alias("rate"))
    until = F.coalesce(F.date_sub(F.lead("a").over(Window.partitionBy("o_custkey").orderBy("a")), 1), F.lit("2099-12-31").cast("date"))
    met = bills.join(rates.withColumn("z", until), "o_custkey").where((F.col("a") <= F.col("y")) & (F.col("z") >= F.col("x")))
    days = F.datediff(F.least("z", "y"), F.greatest("a", "x")) + 1
    fits = met.groupBy("o_orderkey").agg(F.first("billed").alias("billed"), (F.sum(F.col("rate") * days) / 30).alias("prorated"), F.max_by("rate", "a").alias("latest"), F.count("*").alias("n"))
    better = F.abs(F.col("prorated") - F.col("billed")) < F.abs(F.col("latest") - F.col("billed"))
    return fits.select("o_orderkey", "n", F.round(F.when(better, F.col("prorated")).otherwise(F.col("latest")), 6).alias("amount"), F.when(better, "prorated").otherwise("latest").alias("fit"))


#: Utility, schedule class and the flags of its riders.
_COMPONENTS = (("A", "BUILDING", ("A", "R")), ("A", "MACHINERY", ("N",)), ("B", "AUTOMOBILE", ("A", "N", "R")))


@query("""WITH c(utility, class, flag) AS (VALUES """ + ", ".join(f"('{u}', '{c}', '{f}')" for u, c, fs in _COMPONENTS for f in fs) + """),
    l AS (SELECT c_mktsegment AS class, l_returnflag AS flag, CAST(year(l_shipdate) AS INTEGER) AS year, l_extendedprice AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
    SELECT utility, class, flag AS component, year, count(*) AS n, round(sum(p), 2) AS amount FROM l JOIN c USING (class, flag) GROUP BY 1, 2, 3, 4""")
def rider_components(spark: SparkSession, d: str) -> DataFrame:
    """The riders of each utility and schedule by year, for all schedules of a table at once."""
    wanted = values(spark, [(u, c, f) for u, c, fs in _COMPONENTS for f in fs], "utility string, class string, component string")
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("class"))
    lines = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("class", F.col("l_returnflag").alias("component"), F.year("l_shipdate").alias("year"), "l_extendedprice")
    return lines.join(wanted, ["class", "component"]).groupBy("utility", "class", "component", "year").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query("""WITH r AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS f, count(*) FILTER (o_orderstatus = 'P') AS i, count(*) AS n FROM orders GROUP BY 1)
    SELECT c_custkey, coalesce(f, 0) AS fetch_eligible, coalesce(i, 0) AS downloaded_not_imported, CASE WHEN n IS NULL THEN 'lead_without_discovery' WHEN f > 0 THEN 'fetch' WHEN i > 0 THEN 'import' ELSE 'done' END AS work FROM customer LEFT JOIN r ON o_custkey = c_custkey""")
def docket_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What each docket still needs: a first discovery, downloads, imports, or nothing."""
    n = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    records = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(n("O").alias("f"), n("P").alias("i"), F.count("*").alias("n"))
    rows = table(spark, d, "customer").select("c_custkey").join(records, "c_custkey", "left")
    work = F.when(F.col("n").isNull(), "lead_without_discovery").when(F.col("f") > 0, "fetch").when(F.col("i") > 0, "import").otherwise("done")
    return rows.select("c_custkey", F.coalesce("f", F.lit(0)).alias("fetch_eligible"), F.coalesce("i", F.lit(0)).alias("downloaded_not_imported"), work.alias("work"))


@query("""SELECT d.doc_id, lang, CASE WHEN source IS NULL THEN 3 WHEN length(text) > 1000 THEN 2 ELSE 1 END AS priority FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND length(text) >= 200""")
def unknown_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that nothing classifies yet and that are long enough to be, the largest first in line."""
    labelled = table(spark, d, "labels").select("doc_id")
    rows = table(spark, d, "documents").where(F.length("text") >= 200).join(labelled, "doc_id", "left_anti")
    return rows.select("doc_id", "lang", F.when(F.col("source").isNull(), 3).when(F.length("text") > 1000, 2).otherwise(1).alias("priority"))


@query("""WITH v AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1),
    c AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN l_tax * 100 ELSE 0 END) AS fixed, avg(l_discount) AS rate, sum(CASE WHEN l_returnflag = 'N' THEN l_tax * 10 ELSE 0 END) AS rider, count(*) FILTER (l_returnflag = 'N') AS riders FROM lineitem GROUP BY 1)
    SELECT o_custkey, CAST(day AS VARCHAR) AS day, round((fixed + 1000 * rate) / 1000 * 100, 6) AS base_cents, round(CASE WHEN riders > 0 THEN (fixed + 1000 * rate) / 1000 * 100 + rider ELSE (fixed + 1000 * rate) / 1000 * 100 END, 6) AS all_in_cents,
        CASE WHEN riders > 0 THEN 'base_plus_riders' ELSE 'base_only' END AS coverage FROM v JOIN c ON l_orderkey = o_orderkey""")
def blended_history(spark: SparkSession, d: str) -> DataFrame:
    """What a kWh costs at 1000 kWh a month under each version of a schedule, with and without its riders."""
    versions = first_of(table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), ["o_custkey", "day"], [F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "day")
    flag = lambda f, value: F.sum(F.when(F.col("l_returnflag") == f, value).otherwise(0.0))
    charges = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        flag("R", F.col("l_tax") * 100).alias("fixed"), F.avg("l_discount").alias("rate"), flag("N", F.col("l_tax") * 10).alias("rider"), F.count(F.when(F.col("l_returnflag") == "N", 1)).alias("riders")
    )
    base = (F.col("fixed") + F.col("rate") * 1000) / 1000 * 100
    known = F.col("riders") > 0
    return versions.join(charges, "o_orderkey").select(
        "o_custkey", F.col("day").cast("string").alias("day"), F.round(base, 6).alias("base_cents"), F.round(F.when(known, base + F.col("rider")).otherwise(base), 6).alias("all_in_cents"),
        F.when(known, "base_plus_riders").otherwise("base_only").alias("coverage"),
    )


@query("""WITH c AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}|[A-Za-z0-9.]+@[a-z0-9.]+'))) AS value FROM documents WHERE text LIKE '%-%' OR text LIKE '%@%'),
    e AS (SELECT doc_id, value, CAST((length(text) - length(replace(text, value, ''))) / length(value) AS BIGINT) AS seen, regexp_matches(lower(text), 'phone|call|mail|contact|@') AS near FROM c)
    SELECT doc_id, value, seen, CASE WHEN seen > 1 THEN 'needs_review' WHEN near THEN 'accepted' ELSE 'rejected' END AS status FROM e""")
def extraction_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Values extracted from texts, each held against its text: found once next to words that go with it, found more than once, or bare."""
    pattern = "[0-9]{3}-[0-9]{4}|[A-Za-z0-9.]+@[a-z0-9.]+"
    some = table(spark, d, "documents").where(F.contains("text", F.lit("-")) | F.contains("text", F.lit("@")))
    values_found = some.select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("value"))
    seen = ((F.length("text") - F.length(F.replace("text", "value", F.lit("")))) / F.length("value")).cast("bigint")
    near = F.lower("text").rlike("phone|call|mail|contact|@")
    return values_found.select("doc_id", "value", seen.alias("seen"), F.when(seen > 1, "needs_review").when(near, "accepted").otherwise("rejected").alias("status"))
