"""Queries over effective-dated history: versions as of a date, timelines, gaps, audits, regional prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratelake.functions.calendar import month_number
from ratelake.operators.asof import carried_together, coverage_status, select_version
from ratelake.operators.compare import band, findings, quartile_outliers, score
from ratelake.operators.graph import chains
from ratelake.operators.latest import first_of, keep_latest, union_distinct
from ratelake.operators.sequences import gaps, islands, missing_numbers, previous

from .registry import query, table


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))


@query("""WITH r AS (SELECT c_custkey, unnest([DATE '1994-01-01', DATE '1997-06-15', DATE '2003-01-01']) AS ref FROM customer),
    u AS (SELECT *, CAST(o_orderdate AS DATE) AS day, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS any_f FROM orders)
    SELECT c_custkey, CAST(ref AS VARCHAR) AS ref, o_orderkey, CAST(day AS VARCHAR) AS day FROM r JOIN u ON o_custkey = c_custkey WHERE o_orderstatus = 'F' OR any_f = 0
    QUALIFY row_number() OVER (PARTITION BY c_custkey, ref ORDER BY CASE WHEN day <= ref THEN 0 ELSE 1 END,
        CASE WHEN day <= ref THEN -date_diff('day', DATE '1970-01-01', day) ELSE date_diff('day', DATE '1970-01-01', day) END, o_orderkey) = 1""")
def version_asof_select(spark: SparkSession, d: str) -> DataFrame:
    """The version in effect on three dates: approved ones first, the earliest where all lie ahead."""
    dates = F.explode(F.array(*(F.lit(x).cast("date") for x in ("1994-01-01", "1997-06-15", "2003-01-01")))).alias("ref")
    asked = table(spark, d, "customer").select("c_custkey", dates)
    versions = _orders(spark, d).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "day", F.col("o_orderstatus").alias("status"))
    found = select_version(asked, versions, ["c_custkey"], "ref", "day", ["o_orderkey"], F.col("status") == "F")
    return found.select("c_custkey", F.col("ref").cast("string").alias("ref"), "o_orderkey", F.col("day").cast("string").alias("day"))


_TIMELINE_SQL = """WITH b AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS base FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1),
    r AS (SELECT o_custkey AS k, CAST(l_shipdate AS DATE) AS d, max(l_extendedprice) AS rider FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    s AS (SELECT k, d FROM b UNION SELECT k, d FROM r)
    SELECT s.k, s.d, b.d AS base_at, b.base, r.d AS rider_at, r.rider FROM s ASOF LEFT JOIN b ON s.k = b.k AND s.d >= b.d ASOF LEFT JOIN r ON s.k = r.k AND s.d >= r.d"""


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    """Every date on which a customer's base or rider changes, with both as they stand on it."""
    orders = _orders(spark, d)
    base = orders.select(F.col("o_custkey").alias("k"), F.col("day").alias("base_at"), "o_orderkey", F.col("o_totalprice").alias("base"))
    lines = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rider = lines.groupBy(F.col("o_custkey").alias("k"), F.to_date("l_shipdate").alias("rider_at")).agg(F.max("l_extendedprice").alias("rider"))
    return carried_together([(base, "base_at", ["o_orderkey"]), (rider, "rider_at", [])], ["k"], "at")


@query(f"SELECT k AS custkey, CAST(d AS VARCHAR) AS day, base, rider, round(coalesce(base, 0) + coalesce(rider, 0), 2) AS all_in FROM ({_TIMELINE_SQL})")
def asof_two_stage_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Base and rider carried forward onto one spine of dates."""
    total = F.round(F.coalesce("base", F.lit(0.0)) + F.coalesce("rider", F.lit(0.0)), 2).alias("all_in")
    return _timeline(spark, d).select(F.col("k").alias("custkey"), F.col("at").cast("string").alias("day"), "base", "rider", total)


@query(f"""SELECT CASE WHEN base_at IS NULL THEN 'uncovered' WHEN base_at = d THEN 'same_day' ELSE 'carried_forward' END AS base_status,
    CASE WHEN rider_at IS NULL THEN 'uncovered' WHEN rider_at = d THEN 'same_day' ELSE 'carried_forward' END AS rider_status, count(*) AS n FROM ({_TIMELINE_SQL}) GROUP BY 1, 2""")
def asof_coverage_status(spark: SparkSession, d: str) -> DataFrame:
    """How often base and rider of the timeline are of the day, carried forward or absent."""
    base = coverage_status(F.col("at"), F.col("base_at")).alias("base_status")
    return _timeline(spark, d).groupBy(base, coverage_status(F.col("at"), F.col("rider_at")).alias("rider_status")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT l_partkey, l_returnflag, CAST(l_shipdate AS DATE) AS day, row_number() OVER w AS rn,
        lag(l_returnflag) OVER w AS pf, lag(CAST(l_shipdate AS DATE)) OVER w AS pd FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice)),
    g AS (SELECT *, sum(CASE WHEN pf IS NULL OR pf <> l_returnflag OR day - pd > 45 THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey ORDER BY rn) AS island FROM l)
    SELECT l_partkey, CAST(island AS BIGINT) AS island, min(l_returnflag) AS flag, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS n FROM g GROUP BY 1, 2""")
def observed_value_islands(spark: SparkSession, d: str) -> DataFrame:
    """Streaks of one value with gaps of at most 45 days."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_extendedprice")
    new = (previous("l_returnflag") != F.col("l_returnflag")) | (F.datediff("day", previous("day")) > 45)
    streaks = islands(rows, ["l_partkey"], ["day", "l_orderkey", "l_linenumber", "l_extendedprice"], new)
    return streaks.groupBy("l_partkey", F.col("island").cast("bigint").alias("island")).agg(
        F.min("l_returnflag").alias("flag"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.count("*").alias("n")
    )


@query("""WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS a, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
    SELECT o_custkey, CAST(a AS VARCHAR) AS gap_start, CAST(b AS VARCHAR) AS gap_end, CAST(b - a AS INTEGER) AS gap_days FROM o WHERE b - a >= 180""")
def temporal_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Half a year or more between one order and the next."""
    out = gaps(_orders(spark, d), ["o_custkey"], "day", 180, ["o_orderkey"])
    return out.select("o_custkey", F.col("gap_start").cast("string").alias("gap_start"), F.col("gap_end").cast("string").alias("gap_end"), "gap_days")


@query("""WITH k AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS n FROM lineitem), r AS (SELECT l_orderkey, min(n) AS a, max(n) AS b FROM k GROUP BY 1)
    SELECT l_orderkey, missing FROM (SELECT l_orderkey, unnest(generate_series(a, b)) AS missing FROM r) x WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.l_orderkey = x.l_orderkey AND k.n = x.missing)""")
def ordinal_missing(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers that an order skips."""
    return missing_numbers(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


_YEARS = list(range(1995, 2002))
_BY_REGION = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _order_regions(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return _orders(spark, d).join(people, F.col("o_custkey") == F.col("c_custkey")).withColumn("year", F.year("day"))


@query("SELECT r_name, " + ", ".join(f"count(*) FILTER (year(o_orderdate) = {y}) AS y{y}" for y in _YEARS) + f" FROM {_BY_REGION} GROUP BY 1")
def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Orders by region and year, one column for each year."""
    wide = _order_regions(spark, d).groupBy("r_name").pivot("year", _YEARS).count().na.fill(0)
    return wide.select("r_name", *(F.col(str(y)).alias(f"y{y}") for y in _YEARS))


_CHARGES_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day, o_totalprice, count(l_orderkey) AS charge_count,
    sum(CASE WHEN l_quantity IS NULL THEN 1 ELSE 0 END) AS null_count, count(DISTINCT l_returnflag) AS periods, coalesce(sum(l_extendedprice), 0) AS charged,
    max(count(l_orderkey)) OVER (PARTITION BY o_custkey) AS peak, count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS same_start
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 5"""


def _version_charges(spark: SparkSession, d: str) -> DataFrame:
    """One row per version with counts of its charges; a version without charges has one null, its unmatched row."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("charge_count"), F.sum(F.when(F.col("l_quantity").isNull(), 1).otherwise(0)).alias("null_count"),
        F.countDistinct("l_returnflag").alias("periods"), F.sum("l_extendedprice").alias("charged"),
    )
    rows = _orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus", "day", "o_totalprice").join(lines, "o_orderkey", "left")
    rows = rows.withColumn("null_count", F.coalesce("null_count", F.lit(1))).na.fill(0)
    family = Window.partitionBy("o_custkey")
    return rows.withColumns({"peak": F.max("charge_count").over(family), "same_start": F.count("*").over(Window.partitionBy("o_custkey", "day"))})


@query(f"SELECT o_orderkey, charge_count, CAST(null_count AS BIGINT) AS null_rate_count, periods, round(charged, 2) AS charged FROM ({_CHARGES_SQL})")
def version_charge_summary(spark: SparkSession, d: str) -> DataFrame:
    """Charges of each version counted; without any the null count is 1, as for an unmatched outer row."""
    return _version_charges(spark, d).select("o_orderkey", "charge_count", F.col("null_count").alias("null_rate_count"), "periods", F.round("charged", 2).alias("charged"))


@query(f"""WITH c AS ({_CHARGES_SQL})
    SELECT o_orderkey, 'zero_charge_version' AS finding FROM c WHERE charge_count = 0 UNION ALL SELECT o_orderkey, 'null_rate_rows' FROM c WHERE null_count > 0
    UNION ALL SELECT o_orderkey, 'sparse_vs_family_peak' FROM c WHERE charge_count > 0 AND peak >= 4 AND charge_count < 4 AND round(charge_count / peak, 3) <= 0.4
    UNION ALL SELECT o_orderkey, 'missing_periods' FROM c WHERE charge_count > 1 AND periods = 1 UNION ALL SELECT o_orderkey, 'duplicate_start' FROM c WHERE same_start > 1
    UNION ALL SELECT o_orderkey, 'total_below_charges' FROM c WHERE o_totalprice < charged UNION ALL SELECT o_orderkey, 'open_and_old' FROM c WHERE o_orderstatus = 'O' AND day < DATE '1996-01-01'""")
def anomaly_multi_rule(spark: SparkSession, d: str) -> DataFrame:
    """Seven rules on each version; every rule that holds is a finding."""
    n, peak = F.col("charge_count"), F.col("peak")
    rules = {
        "zero_charge_version": n == 0, "null_rate_rows": F.col("null_count") > 0,
        "sparse_vs_family_peak": (n > 0) & (peak >= 4) & (n < 4) & (F.round(n / peak, 3) <= 0.4),
        "missing_periods": (n > 1) & (F.col("periods") == 1), "duplicate_start": F.col("same_start") > 1, "total_below_charges": F.col("o_totalprice") < F.col("charged"),
        "open_and_old": (F.col("o_orderstatus") == "O") & (F.col("day") < "1996-01-01"),
    }
    return findings(_version_charges(spark, d), rules, "o_orderkey")


_TRUST_SQL = """WITH m AS (SELECT l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) AS mon, count(*) AS n, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r,
        max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS f, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
    s AS (SELECT *, 0.40 * r + 0.25 * f + CASE WHEN q >= 25 THEN 0.25 ELSE 0 END + CASE WHEN coalesce(mon - lag(mon) OVER (PARTITION BY l_suppkey ORDER BY mon), 0) > 6 THEN 0 ELSE 0.10 END AS t FROM m)"""


@query(f"""{_TRUST_SQL} SELECT l_suppkey, CAST(mon AS INTEGER) AS month_number, round(CAST(t AS DOUBLE), 4) AS trust_score,
    CASE WHEN round(t, 4) >= 0.8 THEN 'high' WHEN round(t, 4) >= 0.5 THEN 'medium' WHEN round(t, 4) >= 0.25 THEN 'low' ELSE 'unverified' END AS trust_tier FROM s""")
def trust_score(spark: SparkSession, d: str) -> DataFrame:
    """Weights 0.40, 0.25, 0.25 for evidence and 0.10 for continuity (no gap of over six months)."""
    mon = month_number(F.to_date("l_shipdate")).alias("month_number")
    has = lambda cond: F.max(cond.cast("int"))
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", mon).agg(has(F.col("l_returnflag") == "R").alias("r"), has(F.col("l_linestatus") == "F").alias("f"), F.max("l_quantity").alias("q"))
    gap = F.col("month_number") - F.lag("month_number").over(Window.partitionBy("l_suppkey").orderBy("month_number"))
    total = score((F.col("r") == 1, 0.40), (F.col("f") == 1, 0.25), (F.col("q") >= 25, 0.25), (F.coalesce(gap, F.lit(0)) <= 6, 0.10))
    rated = rows.withColumn("trust_score", F.round(total, 4))
    tier = F.when(F.col("trust_score") >= 0.8, "high").when(F.col("trust_score") >= 0.5, "medium").when(F.col("trust_score") >= 0.25, "low").otherwise("unverified")
    return rated.select("l_suppkey", "month_number", "trust_score", tier.alias("trust_tier"))


@query(f"""WITH c AS ({_CHARGES_SQL}), f AS (SELECT o_custkey, count(*) AS versions, sum(CASE WHEN charge_count = 0 THEN 1 ELSE 0 END) AS empty_versions,
        sum(CASE WHEN same_start > 1 THEN 1 ELSE 0 END) AS twins, max(peak) AS peak, date_diff('day', max(day), DATE '2001-08-01') AS age FROM c GROUP BY 1),
    s AS (SELECT *, greatest(0, least(100, 100 - least(40, 8 * empty_versions) - least(20, 10 * twins) - CASE WHEN peak < 4 THEN 15 ELSE 0 END - least(30, age // 60))) AS sc FROM f)
    SELECT o_custkey, versions, CAST(sc AS BIGINT) AS confidence, CASE WHEN sc >= 80 THEN 'high' WHEN sc >= 35 THEN 'medium' ELSE 'low' END AS band,
        CASE WHEN empty_versions > 5 THEN 'reparse' WHEN twins > 0 THEN 'merge_duplicates' WHEN age > 365 THEN 'find_newer' ELSE 'none' END AS action FROM s""")
def confidence_audit(spark: SparkSession, d: str) -> DataFrame:
    """A family's confidence from 0 to 100: capped penalties, and the first action that fits."""
    families = _version_charges(spark, d).groupBy("o_custkey").agg(
        F.count("*").alias("versions"), F.sum((F.col("charge_count") == 0).cast("int")).alias("empty"), F.sum((F.col("same_start") > 1).cast("int")).alias("twins"),
        F.max("peak").alias("peak"), F.datediff(F.lit("2001-08-01"), F.max("day")).alias("age"),
    )
    cap = lambda most, x: F.least(F.lit(most), x)
    penalty = cap(40, 8 * F.col("empty")) + cap(20, 10 * F.col("twins")) + F.when(F.col("peak") < 4, 15).otherwise(0) + cap(30, F.expr("age div 60"))
    value = F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty)).cast("bigint")
    action = F.when(F.col("empty") > 5, "reparse").when(F.col("twins") > 0, "merge_duplicates").when(F.col("age") > 365, "find_newer").otherwise("none")
    return families.select("o_custkey", "versions", value.alias("confidence"), band(value, 80, 35).alias("band"), action.alias("action"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) l
    WHERE event_type IN ('error', 'view', 'click') AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = l.user_id AND e.event_type = 'purchase' AND e.ts >= l.ts - INTERVAL 12 HOUR)""")
def latest_attempt_low_quality(spark: SparkSession, d: str) -> DataFrame:
    """Users whose latest event is poor and that bought nothing in the twelve hours before."""
    events = table(spark, d, "events")
    last = first_of(events, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    bought = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("bought"))
    met = last.join(bought, "user_id", "left").where(F.col("event_type").isin("error", "view", "click"))
    return met.where(F.col("bought").isNull() | (F.col("bought") < F.col("ts") - F.expr("INTERVAL 12 HOURS"))).select("user_id", "event_id", "event_type")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, min(l_linenumber) AS kept_line, count(*) - 1 AS n_removed FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1
    UNION ALL SELECT l_orderkey, -1, -1, min(l_linenumber), count(*) - 1 FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_quantity, l_returnflag) AS k FROM lineitem) WHERE k > 1 GROUP BY 1""")
def charge_signature_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Charges that repeat a natural signature, and orders in which the looser signature repeats."""
    lines = table(spark, d, "lineitem")
    kept = [F.min("l_linenumber").alias("kept_line"), (F.count("*") - 1).alias("n_removed")]
    strict = lines.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(*kept).where("n_removed > 0")
    same = Window.partitionBy("l_orderkey", "l_quantity", "l_returnflag")
    loose = lines.withColumn("k", F.count("*").over(same)).where("k > 1").groupBy("l_orderkey").agg(*kept)
    return strict.unionByName(loose, allowMissingColumns=True).na.fill(-1, ["l_partkey", "l_suppkey"])


@query(f"""WITH p AS (SELECT n_name AS state, year(o_orderdate) AS year, avg(o_totalprice) AS price, sum(o_totalprice) AS total, count(*) AS n FROM {_BY_REGION} GROUP BY 1, 2),
    u AS (SELECT year(o_orderdate) AS year, avg(o_totalprice) AS us FROM orders GROUP BY 1),
    j AS (SELECT p.*, us, lag(price) OVER (PARTITION BY state ORDER BY p.year) AS was FROM p JOIN u ON u.year = p.year)
    SELECT state, CAST(year AS INTEGER) AS year, n, round(total, 2) AS total, round(price - us, 3) AS vs_national, round(100 * (price - us) / us, 4) AS vs_national_pct, round(100 * (price - was) / was, 4) AS yoy_pct FROM j""")
def state_vs_national(spark: SparkSession, d: str) -> DataFrame:
    """Average price of each place and year against all, and against its year before."""
    rows = _order_regions(spark, d)
    own = rows.groupBy(F.col("n_name").alias("state"), "year").agg(F.avg("o_totalprice").alias("p"), F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    national = _orders(spark, d).groupBy(F.year("day").alias("year")).agg(F.avg("o_totalprice").alias("us"))
    met = own.join(national, "year").withColumn("was", F.lag("p").over(Window.partitionBy("state").orderBy("year")))
    off = F.col("p") - F.col("us")
    return met.select(
        "state", "year", "n", F.round("total", 2).alias("total"), F.round(off, 3).alias("vs_national"), F.round(100 * off / F.col("us"), 4).alias("vs_national_pct"),
        F.round(100 * (F.col("p") - F.col("was")) / F.col("was"), 4).alias("yoy_pct"),
    )


_FUELS = ["ECONOMY", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("SELECT CAST(year(l_shipdate) AS INTEGER) AS year, "
    + ", ".join(f"round(coalesce(sum(CASE WHEN p_type = '{f}' THEN l_quantity END), 0) / nullif(sum(l_quantity), 0), 4) AS {f.lower()}_share" for f in _FUELS)
    + ", sum(l_quantity) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def fuel_mix_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Shares of each kind in a year's sum, one column for each kind."""
    kinds = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = table(spark, d, "lineitem").select("l_partkey", "l_quantity", F.year("l_shipdate").alias("year")).join(kinds, "l_partkey")
    sums = rows.groupBy("year").agg(F.sum("l_quantity").alias("total"), *(F.sum(F.when(F.col("p_type") == f, F.col("l_quantity"))).alias(f) for f in _FUELS))
    return sums.select("year", *(F.round(F.coalesce(f, F.lit(0.0)) / F.nullif("total", F.lit(0.0)), 4).alias(f"{f.lower()}_share") for f in _FUELS), "total")


@query("""SELECT n_name, round(a, 4) AS price, CAST(row_number() OVER (ORDER BY a DESC, n_name) AS INTEGER) AS rank FROM (SELECT n_name, avg(c_acctbal) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)""")
def price_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Places by average price; one row for each place, so ranking them takes one small partition."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    places = rows.groupBy("n_name").agg(F.avg("c_acctbal").alias("a"))
    return places.select("n_name", F.round("a", 4).alias("price"), F.row_number().over(Window.orderBy(F.desc("a"), "n_name")).alias("rank"))


@query("""SELECT r_name, round(median(a), 4) AS median_price, round(avg(a), 4) AS mean_price, round(min(a), 4) AS low, round(max(a), 4) AS high, count(*) AS n, string_agg(n_name, ', ' ORDER BY n_name) AS members
    FROM (SELECT r_name, n_name, avg(c_acctbal) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) GROUP BY 1""")
def market_structure_median(spark: SparkSession, d: str) -> DataFrame:
    """Median and mean of the places of each group, and their names."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.avg("c_acctbal").alias("a"))
    return rows.groupBy("r_name").agg(
        F.round(F.median("a"), 4).alias("median_price"), F.round(F.avg("a"), 4).alias("mean_price"), F.round(F.min("a"), 4).alias("low"), F.round(F.max("a"), 4).alias("high"),
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("members"),
    )


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_min, count(DISTINCT json_extract_string(props, '$.k')) AS k_distinct FROM events GROUP BY 1""")
def json_props_explode(spark: SparkSession, d: str) -> DataFrame:
    """A field of a JSON column by event type."""
    k = F.get_json_object("props", "$.k")
    rows = table(spark, d, "events").select("event_type", k.alias("k"), k.try_cast("bigint").alias("v"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("v").alias("k_sum"), F.min("v").alias("k_min"), F.countDistinct("k").alias("k_distinct"))


@query("""WITH n AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value <> 0),
    q AS (SELECT event_type, max(CASE WHEN i = c // 4 + 1 THEN value END) AS q1, max(CASE WHEN i = 3 * c // 4 + 1 THEN value END) AS q3 FROM n WHERE c >= 3 GROUP BY 1)
    SELECT event_type, event_id, value, q1, q3 FROM n JOIN q USING (event_type) WHERE value < q1 - 3 * CASE WHEN q3 > q1 THEN q3 - q1 ELSE 1 END OR value > q3 + 3 * CASE WHEN q3 > q1 THEN q3 - q1 ELSE 1 END""")
def iqr_outliers_index(spark: SparkSession, d: str) -> DataFrame:
    """Values far outside the quartiles of their kind."""
    out = quartile_outliers(table(spark, d, "events").where("value <> 0"), ["event_type"], "value")
    return out.select("event_type", "event_id", "value", "q1", "q3")


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS node, p_partkey AS root, 0 AS depth FROM part WHERE p_partkey % 97 = 0
        UNION ALL SELECT p_partkey, root, depth + 1 FROM c JOIN part ON p_partkey % 97 <> 0 AND p_partkey - 1 = node)
    SELECT node AS p_partkey, root, CAST(depth AS BIGINT) AS depth FROM c""")
def supersession_chain(spark: SparkSession, d: str) -> DataFrame:
    """First ancestor and number of steps to it, for rows that each supersede another."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 97 != 0, F.col("p_partkey") - 1).alias("parent"))
    return chains(parts).select(F.col("node").alias("p_partkey"), "root", "depth")


@query("""SELECT o_orderstatus, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderdate, o_orderkey) = 1""")
def next_in_queue(spark: SparkSession, d: str) -> DataFrame:
    """The next action of each queue: highest priority, then longest waiting."""
    return first_of(table(spark, d, "orders"), ["o_orderstatus"], ["o_orderpriority", "o_orderdate", "o_orderkey"]).select("o_orderstatus", "o_orderkey", "o_orderpriority")


@query("SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def union_sources_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Keys that either source has."""
    bad = [table(spark, d, t).where(f"{t[0]}_acctbal < 0").select(F.col(f"{t[0]}_nationkey").alias("nationkey")) for t in ("customer", "supplier")]
    return union_distinct(*bad)


@query("""SELECT k, day, price FROM (SELECT o_custkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_totalprice AS price, o_orderkey AS v FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1)""")
def upsert_keep_latest(spark: SparkSession, d: str) -> DataFrame:
    """Two loads merged by key; the later record wins."""
    rows = _orders(spark, d).select(F.col("o_custkey").alias("k"), F.col("day").cast("string").alias("day"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("v"))
    return keep_latest(rows.where("price < 200000"), rows.where("price >= 200000"), ["k", "day"], "v").select("k", "day", "price")
