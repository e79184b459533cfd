"""Queries over usage: tiers, time of use, riders, minimum bills, schedules compared, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratelake.functions.calendar import overlap_days, tou_period
from ratelake.operators.compare import accuracy_band, range_sum, reconcile
from ratelake.operators.latest import first_of
from ratelake.operators.sequences import allocate_tiers

from . import billing
from .registry import query, table, values

TIERS = [("first", 0.0, 200.0, 0.125), ("second", 200.0, 500.0, 0.11), ("rest", 500.0, None, 0.1)]
PLANS = [("basic", 10.0, 0.125), ("plus", 15.0, 0.11), ("flat", 25.0, 0.1), ("metered", 0.0, 0.16)]
_WEEKS = "SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, sum(value) AS kwh FROM events GROUP BY 1, 2"


def weekly_usage(spark: SparkSession, d: str) -> DataFrame:
    """kWh of each user and ISO week."""
    week = F.to_date(F.date_trunc("week", "ts")).alias("week")
    return table(spark, d, "events").groupBy("user_id", week).agg(F.sum("value").alias("kwh"))


def _tier_rows(spark: SparkSession, d: str) -> DataFrame:
    tiers = values(spark, TIERS, "tier string, low double, high double, rate double")
    rows = weekly_usage(spark, d).crossJoin(F.broadcast(tiers))
    return allocate_tiers(rows, ["user_id", "week"], "kwh", "low", "high").withColumn("amount", F.col("tier_quantity") * F.col("rate"))


_TIER_SQL = f"""SELECT *, q * rate AS amount FROM (
    SELECT w.*, tier, rate, least(coalesce(high, 1e18) - low, greatest(kwh - low, 0)) AS q FROM ({_WEEKS}) w,
    (VALUES ('first', 0.0, 200.0, 0.125), ('second', 200.0, 500.0, 0.11), ('rest', 500.0, NULL, 0.1)) t(tier, low, high, rate))"""


@query(f"SELECT user_id, CAST(week AS VARCHAR) AS week, tier, round(CAST(q AS DOUBLE), 6) AS tier_kwh, round(CAST(amount AS DOUBLE), 6) AS amount FROM ({_TIER_SQL})")
def bill_tiered_period(spark: SparkSession, d: str) -> DataFrame:
    """Weekly kWh of each user, dealt into tiers and priced."""
    return _tier_rows(spark, d).select("user_id", F.col("week").cast("string").alias("week"), "tier", F.round("tier_quantity", 6).alias("tier_kwh"), F.round("amount", 6).alias("amount"))


_VERSIONS = [
    (1, "standard", "2023-01-01", "approved"), (2, "standard", "2024-01-15", "approved"), (3, "standard", "2024-01-20", "proposed"),
    (4, "green", "2024-01-08", "approved"), (5, "rider", "2024-01-10", "approved"),
]
_CHARGES = [
    (1, 1, "fixed", "Basic", 14.0, "$/month", None, None), (2, 1, "energy_block", "Energy", 12.5, "cents/kWh", 0.0, 200.0),
    (3, 1, "energy_block", "Energy", 11.0, "cents/kWh", 200.0, None), (4, 2, "fixed", "Basic", 15.0, "$/month", None, None),
    (5, 2, "energy_block", "Energy", 13.0, "cents/kWh", 0.0, 200.0), (6, 2, "energy_block", "Energy", 11.5, "cents/kWh", 200.0, None),
    (7, 3, "fixed", "Basic", 99.0, "$/month", None, None), (8, 4, "fixed", "Basic", 20.0, "$/month", None, None),
    (9, 4, "energy_block", "Energy", 10.0, "cents/kWh", None, None), (10, 4, "minimum", "Minimum", 45.0, "$/month", None, None),
    (11, 5, "adjustment", "Rider", 0.5, "cents/kWh", None, None),
]


@query(f"""
    WITH u AS (SELECT user_id, week, kwh, CASE WHEN user_id % 2 = 0 THEN 'standard' ELSE 'green' END AS family_key FROM ({_WEEKS})),
    b AS (SELECT *, CASE WHEN family_key = 'green' THEN 4 WHEN week >= DATE '2024-01-15' THEN 2 ELSE 1 END AS version_id FROM u),
    e AS (SELECT *, CASE version_id
        WHEN 1 THEN 14.0 + 0.125 * least(kwh, 200) + 0.11 * greatest(kwh - 200, 0)
        WHEN 2 THEN 15.0 + 0.13 * least(kwh, 200) + 0.115 * greatest(kwh - 200, 0) ELSE 20.0 + 0.1 * kwh END AS base,
        CASE WHEN family_key = 'standard' AND week BETWEEN DATE '2024-01-08' AND DATE '2024-01-22' THEN 0.005 * kwh ELSE 0 END AS rider FROM b)
    SELECT user_id, CAST(week AS VARCHAR) AS week, family_key, CAST(version_id AS BIGINT) AS version_id, round(CAST(base AS DOUBLE), 5) AS base_subtotal,
        round(CAST(rider AS DOUBLE), 5) AS rider_subtotal,
        round(CAST(CASE WHEN family_key = 'green' THEN greatest(base + rider, 45.0) ELSE base + rider END AS DOUBLE), 5) AS total FROM e""")
def bill_versions_and_riders(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: weekly bills with the version in effect, tiers, a dated rider and a minimum, in one plan."""
    usage = weekly_usage(spark, d).select(
        F.concat_ws("|", F.col("user_id").cast("string"), F.col("week").cast("string")).alias("usage_id"), "user_id", "week",
        F.col("week").alias("service_date"), F.col("kwh").alias("monthly_kwh"), F.when(F.col("user_id") % 2 == 0, "standard").otherwise("green").alias("family_key"),
    )
    versions = values(spark, _VERSIONS, "version_id bigint, family_key string, effective_start string, status string")
    charges = values(spark, _CHARGES, "charge_id bigint, version_id bigint, charge_type string, charge_label string, rate_value double, rate_unit string, tier_min double, tier_max double")
    charges = charges.withColumns({c: F.lit(None).cast("string") for c in ("tou_period", "season", "customer_class")}).withColumn("confidence_score", F.lit(0.9))
    links = values(
        spark, [("rider", "standard", True, None, "2024-01-08", "2024-01-22")],
        "rider_family_key string, applies_to_family_key string, mandatory boolean, enrollment_type string, effective_start string, effective_end string",
    )
    billed = billing.bills(usage, versions, charges, links, places=6)
    return billed.join(usage.select("usage_id", "user_id", "week"), "usage_id").select(
        "user_id", F.col("week").cast("string").alias("week"), "family_key", "version_id", *(F.round(c, 5).alias(c) for c in ("base_subtotal", "rider_subtotal", "total"))
    )


_TOU_SQL = """SELECT *, CASE WHEN isodow(ts) >= 6 OR CAST(ts AS DATE) IN (DATE '2024-01-01', DATE '2024-05-27', DATE '2024-07-04', DATE '2024-09-02', DATE '2024-11-28', DATE '2024-12-25') THEN 'off_peak'
    WHEN hour(ts) >= 21 OR hour(ts) < 6 THEN 'discount' WHEN hour(ts) >= 14 THEN 'on_peak' ELSE 'off_peak' END AS period FROM events"""


@query(f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, period, round(sum(value), 6) AS kwh, max(value) AS peak, count(*) AS n FROM ({_TOU_SQL}) GROUP BY 1, 2")
def tou_classify_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and time-of-use period, holidays as off peak."""
    day = F.to_date("ts").cast("string").alias("day")
    return table(spark, d, "events").groupBy(day, tou_period(F.col("ts")).alias("period")).agg(F.round(F.sum("value"), 6).alias("kwh"), F.max("value").alias("peak"), F.count("*").alias("n"))


@query(f"""SELECT user_id, coalesce(p, 'unallocated') AS period, round(sum(value), 6) AS kwh, round(CAST(sum(value * coalesce(rate, 0)) AS DOUBLE), 6) AS amount, count(*) AS n
    FROM ({_TOU_SQL}) LEFT JOIN (VALUES ('on_peak', 0.25), ('off_peak', 0.125)) r(p, rate) ON period = p GROUP BY 1, 2""")
def tou_energy_charge(spark: SparkSession, d: str) -> DataFrame:
    """Priced kWh of each user and period; kWh in periods without a rate are unallocated."""
    rates = values(spark, [("on_peak", 0.25), ("off_peak", 0.125)], "p string, rate double")
    rows = table(spark, d, "events").select("user_id", "value", tou_period(F.col("ts")).alias("period")).join(F.broadcast(rates), F.col("period") == F.col("p"), "left")
    amount = F.round(F.sum(F.col("value") * F.coalesce("rate", F.lit(0.0))), 6).alias("amount")
    return rows.groupBy("user_id", F.coalesce("p", F.lit("unallocated")).alias("period")).agg(F.round(F.sum("value"), 6).alias("kwh"), amount, F.count("*").alias("n"))


@query("""SELECT l_partkey, count(*) AS n_kept, sum(l_quantity) AS kw FROM (SELECT DISTINCT l_partkey, l_quantity, l_returnflag FROM lineitem) GROUP BY 1""")
def demand_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Demand lines that repeat label, rate and season count once."""
    rows = first_of(table(spark, d, "lineitem"), ["l_partkey", "l_quantity", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return rows.groupBy("l_partkey").agg(F.count("*").alias("n_kept"), F.sum("l_quantity").alias("kw"))


@query("""WITH l AS (SELECT *, DATE '1995-01-01' + CAST(s_suppkey * 17 % 2000 AS INTEGER) AS a FROM supplier),
    m AS (SELECT *, CASE WHEN s_suppkey % 7 <> 0 THEN a + CAST(400 + s_suppkey % 5 * 100 AS INTEGER) END AS b FROM l),
    j AS (SELECT c_custkey, s_suppkey, s_suppkey % 3 AS rider_group, a FROM customer JOIN m ON c_nationkey = s_nationkey WHERE a <= DATE '1997-07-01' AND (b IS NULL OR b >= DATE '1997-07-01'))
    SELECT c_custkey, rider_group, s_suppkey FROM j QUALIFY row_number() OVER (PARTITION BY c_custkey, rider_group ORDER BY a DESC, s_suppkey) = 1""")
def rider_active_links(spark: SparkSession, d: str) -> DataFrame:
    """Links in force on a day, ends included, and per customer and rider the one that began last."""
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") * 17 % 2000).cast("int"))
    links = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", start.alias("a"))
    links = links.withColumn("b", F.when(F.col("s_suppkey") % 7 != 0, F.date_add("a", (400 + F.col("s_suppkey") % 5 * 100).cast("int"))))
    day = F.lit("1997-07-01").cast("date")
    live = links.where((F.col("a") <= day) & (F.col("b").isNull() | (F.col("b") >= day))).withColumn("rider_group", F.col("s_suppkey") % 3)
    # Links of one place and rider are settled before they meet its customers.
    best = first_of(live, ["s_nationkey", "rider_group"], [F.desc("a"), "s_suppkey"])
    return table(spark, d, "customer").join(best, F.col("c_nationkey") == F.col("s_nationkey")).select("c_custkey", "rider_group", "s_suppkey")


@query(f"""SELECT user_id, CAST(week AS VARCHAR) AS week, round(CAST(sum(amount) AS DOUBLE), 6) AS energy, round(CAST(-0.05 * sum(amount) AS DOUBLE), 7) AS discount FROM ({_TIER_SQL}) GROUP BY 1, 2""")
def percent_energy_rider(spark: SparkSession, d: str) -> DataFrame:
    """A rider that gives back five percent of the energy lines."""
    energy = _tier_rows(spark, d).groupBy("user_id", F.col("week").cast("string").alias("week")).agg(F.sum("amount").alias("e"))
    return energy.select("user_id", "week", F.round("e", 6).alias("energy"), F.round(F.col("e") * -0.05, 7).alias("discount"))


@query(f"""SELECT user_id, CAST(week AS VARCHAR) AS week, round(CAST(sum(amount) AS DOUBLE), 6) AS subtotal, round(CAST(greatest(30 - sum(amount), 0) AS DOUBLE), 6) AS shortfall FROM ({_TIER_SQL}) GROUP BY 1, 2""")
def minimum_bill_shortfall(spark: SparkSession, d: str) -> DataFrame:
    """What a bill lacks to the minimum."""
    sums = _tier_rows(spark, d).groupBy("user_id", F.col("week").cast("string").alias("week")).agg(F.sum("amount").alias("s"))
    return sums.select("user_id", "week", F.round("s", 6).alias("subtotal"), F.round(F.greatest(30 - F.col("s"), F.lit(0.0)), 6).alias("shortfall"))


@query("""WITH u AS (SELECT user_id, sum(value) AS kwh FROM events GROUP BY 1),
    p AS (SELECT user_id, plan, fixed + kwh * rate AS t FROM u, (VALUES ('basic', 10.0, 0.125), ('plus', 15.0, 0.11), ('flat', 25.0, 0.1), ('metered', 0.0, 0.16)) x(plan, fixed, rate))
    SELECT user_id, plan, round(CAST(t AS DOUBLE), 6) AS total, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t, plan) AS INTEGER) AS rank FROM p""")
def compare_schedules_rank(spark: SparkSession, d: str) -> DataFrame:
    """Every user's usage under every schedule, cheapest first."""
    usage = table(spark, d, "events").groupBy(F.col("user_id").alias("usage_id")).agg(F.sum("value").alias("monthly_kwh"))
    families = values(spark, [(p[0],) for p in PLANS], "family_key string")
    versions = values(spark, [(i, p[0], "approved") for i, p in enumerate(PLANS)], "version_id bigint, family_key string, status string").withColumn("effective_start", F.lit(None).cast("date"))
    nothing = {c: F.lit(None).cast("double") for c in ("tier_min", "tier_max")} | {c: F.lit(None).cast("string") for c in ("tou_period", "season", "customer_class")}
    lines = [(2 * i + k, i, kind, label, rate, unit) for i, (_, fixed, rate_value) in enumerate(PLANS) for k, (kind, label, rate, unit) in enumerate((("fixed", "customer charge", float(fixed), "$/month"), ("energy_block", "energy", float(rate_value), "$/kWh")))]
    charges = values(spark, lines, "charge_id bigint, version_id bigint, charge_type string, charge_label string, rate_value double, rate_unit string").withColumns(nothing | {"confidence_score": F.lit(1.0)})
    ranked = billing.compare_schedules(usage, families, versions, charges, places=6)
    return ranked.select(F.col("for_usage").alias("user_id"), F.col("family_key").alias("plan"), "total", "rank")


_SUN = [0.12, 0.14, 0.17, 0.2, 0.21, 0.22, 0.21, 0.2, 0.18, 0.16, 0.13, 0.11]


@query(f"""WITH u AS (SELECT user_id, sum(value) AS kwh FROM events GROUP BY 1),
    m AS (SELECT user_id, size, kwh, size * cf * 730 * 0.86 AS made FROM u, (VALUES (0.25), (0.5), (1.0), (2.0)) s(size), (SELECT unnest({_SUN}) AS cf)),
    y AS (SELECT user_id, size, sum(least(made, kwh)) AS used, sum(greatest(made - kwh, 0)) AS spare FROM m GROUP BY 1, 2)
    SELECT CAST(size AS DOUBLE) AS size, round(sum(used * 0.125 + spare * 0.03), 9) AS savings, round(count(*) * size * 1000 * 2.75 / sum(used * 0.125 + spare * 0.03), 6) AS payback_years FROM y GROUP BY size""")
def solar_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Savings and payback of system sizes over twelve months of output."""
    usage = table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("kwh"))
    sizes = values(spark, [(0.25,), (0.5,), (1.0,), (2.0,)], "size double")
    months = values(spark, [(c,) for c in _SUN], "cf double")
    rows = usage.crossJoin(F.broadcast(sizes.crossJoin(months))).withColumn("made", F.col("size") * F.col("cf") * 730 * 0.86)
    value = F.sum(F.least("made", "kwh")) * 0.125 + F.sum(F.greatest(F.col("made") - F.col("kwh"), F.lit(0.0))) * 0.03
    each = rows.groupBy("user_id", "size").agg(value.alias("worth"))
    return each.groupBy("size").agg(F.round(F.sum("worth"), 9).alias("savings"), F.round(F.count("*") * F.col("size") * 1000 * 2.75 / F.sum("worth"), 6).alias("payback_years"))


_SEGMENTS = "(VALUES (DATE '1995-01-01', DATE '1996-06-30', 0.5), (DATE '1996-07-01', DATE '1998-03-31', 0.75), (DATE '1998-04-01', DATE '2001-12-31', 0.25)) s(a, b, rate)"


@query(f"""WITH p AS (SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS x, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS y FROM orders),
    j AS (SELECT o_orderkey, o_totalprice, rate, least(y, b) - greatest(x, a) + 1 AS days, CAST(y - x + 1 AS INTEGER) AS n FROM p JOIN {_SEGMENTS} ON x <= b AND y >= a)
    SELECT o_orderkey, n AS n_days, count(*) AS n_segments, round(CAST(sum(o_totalprice * rate * days) AS DOUBLE), 4) AS amount_days FROM j GROUP BY 1, 2""")
def rolling_proration(spark: SparkSession, d: str) -> DataFrame:
    """An amount weighted by the days that each rate segment shares with its period, and the days of the period."""
    segments = values(
        spark, [("1995-01-01", "1996-06-30", 0.5), ("1996-07-01", "1998-03-31", 0.75), ("1998-04-01", "2001-12-31", 0.25)], "a string, b string, rate double"
    ).select(F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"), "rate")
    start = F.to_date("o_orderdate")
    periods = table(spark, d, "orders").select("o_orderkey", "o_totalprice", start.alias("x"), F.date_add(start, (F.col("o_orderkey") % 40).cast("int")).alias("y"))
    met = periods.join(F.broadcast(segments), (F.col("x") <= F.col("b")) & (F.col("y") >= F.col("a")))
    shared = overlap_days(F.col("x"), F.col("y"), F.col("a"), F.col("b"))
    days = (F.datediff("y", "x") + 1).alias("n_days")
    return met.groupBy("o_orderkey", days).agg(F.count("*").alias("n_segments"), F.round(F.sum(F.col("o_totalprice") * F.col("rate") * shared), 4).alias("amount_days"))


_RECONCILE_SQL = """SELECT coalesce(k1, k2) AS order_key, a AS actual_amount, e AS estimated_amount,
    CASE WHEN k1 IS NULL THEN 'estimated_only' WHEN k2 IS NULL THEN 'actual_only' ELSE 'matched' END AS status, coalesce(e, 0) - coalesce(a, 0) AS delta
    FROM (SELECT o_orderkey AS k1, sum(o_totalprice) AS a FROM orders GROUP BY 1) FULL OUTER JOIN
         (SELECT l_orderkey AS k2, sum(l_extendedprice * (1 - l_discount)) AS e FROM lineitem GROUP BY 1) ON k1 = k2"""


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    actual = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("amount"))
    estimated = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    return reconcile(actual, estimated, ["order_key"], "amount")


@query(f"SELECT order_key, round(actual_amount, 5) AS actual_amount, round(estimated_amount, 5) AS estimated_amount, status, round(delta, 5) AS delta FROM ({_RECONCILE_SQL})")
def reconcile_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Order totals against the sum of their lines."""
    return _reconciled(spark, d).select("order_key", F.round("actual_amount", 5).alias("actual_amount"), F.round("estimated_amount", 5).alias("estimated_amount"), "status", F.round("delta", 5).alias("delta"))


@query(f"""SELECT CASE WHEN abs(delta / 1e5) <= 1.0 THEN 'good_match' WHEN abs(delta / 1e5) <= 2.5 THEN 'close_match' ELSE 'review' END AS band, count(*) AS n, round(max(abs(delta)), 5) AS max_abs_delta
    FROM ({_RECONCILE_SQL}) WHERE status = 'matched' GROUP BY 1""")
def accuracy_status_bands(spark: SparkSession, d: str) -> DataFrame:
    """Matched orders by how far the estimate is off."""
    rows = _reconciled(spark, d).where("status = 'matched'")
    return rows.groupBy(accuracy_band(F.col("delta") / 1e5).alias("band")).agg(F.count("*").alias("n"), F.round(F.max(F.abs("delta")), 5).alias("max_abs_delta"))


@query("""WITH r AS (SELECT c_custkey % 150 AS user_id, CAST(c_custkey AS BIGINT) AS bill_id, DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) AS a, DATE '2024-01-01' + CAST(c_custkey % 20 + 6 AS INTEGER) AS b FROM customer)
    SELECT bill_id, r.user_id, CAST(a AS VARCHAR) AS a, round(sum(value), 6) AS kwh FROM r LEFT JOIN events e ON e.user_id = r.user_id AND CAST(ts AS DATE) BETWEEN a AND b GROUP BY 1, 2, 3""")
def daily_usage_range_sum(spark: SparkSession, d: str) -> DataFrame:
    """kWh within each bill's days."""
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 20).cast("int"))
    ranges = table(spark, d, "customer").select((F.col("c_custkey") % 150).alias("user_id"), F.col("c_custkey").alias("bill_id"), start.alias("a"), F.date_add(start, 6).alias("b"))
    points = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "value")
    out = range_sum(points, ranges, ["user_id"], "day", "a", "b", "value", "kwh")
    return out.select("bill_id", "user_id", F.col("a").cast("string").alias("a"), F.round("kwh", 6).alias("kwh"))


#: Families with a demand charge given twice, a credit a kWh and one a bill, and time-of-use rates that meet usage without periods.
_KINDS = [
    (1, 1, "fixed", "Basic", 10.0, "$/month", None), (2, 1, "energy_block", "Energy", 0.1, "$/kWh", None), (3, 1, "demand", "Demand", 5.0, "$/kW", None), (4, 1, "demand", "Demand", 5.0, "$/kW", None),
    (5, 2, "energy_block", "Energy", 12.0, "cents/kWh", None), (6, 2, "credit", "Credit", 0.02, "$/kWh", None), (7, 2, "credit", "Bill credit", 3.0, "$/month", None),
    (8, 3, "tou_energy", "On peak", 0.3, "$/kWh", "on_peak"), (9, 3, "tou_energy", "Off peak", 0.1, "$/kWh", "off_peak"), (10, 3, "fixed", "Basic", 8.0, "$/month", None),
]


@query(f"""WITH u AS (SELECT user_id, week, kwh, user_id % 3 AS f FROM ({_WEEKS})),
    b AS (SELECT *, CASE f WHEN 0 THEN 10.0::DOUBLE + 0.1::DOUBLE * kwh + 5.0::DOUBLE * kwh / 50 WHEN 1 THEN 0.12::DOUBLE * kwh - 0.02::DOUBLE * kwh - 3.0::DOUBLE ELSE 8.0::DOUBLE + 0.2::DOUBLE * kwh END AS total,
        CASE f WHEN 0 THEN 0.1::DOUBLE * kwh WHEN 1 THEN 0.12::DOUBLE * kwh ELSE 0.2::DOUBLE * kwh END AS energy, CASE f WHEN 0 THEN 3 WHEN 1 THEN 3 ELSE 2 END AS n FROM u)
    SELECT user_id, CAST(week AS VARCHAR) AS week, ['demand', 'credit', 'average'][f + 1] AS family_key, round(energy, 4) AS energy_subtotal, round(total, 4) AS total, CAST(n AS BIGINT) AS n_lines FROM b""")
def demand_credit_average(spark: SparkSession, d: str) -> DataFrame:
    """Weekly bills with demand charges that count once, credits a kWh and a bill, and the average of time-of-use rates where usage has no periods."""
    family = F.element_at(F.array(*map(F.lit, ("demand", "credit", "average"))), (F.col("user_id") % 3 + 1).cast("int"))
    usage = weekly_usage(spark, d).select(
        F.concat_ws("|", F.col("user_id").cast("string"), F.col("week").cast("string")).alias("usage_id"), "user_id", "week", F.col("week").alias("service_date"),
        F.col("kwh").alias("monthly_kwh"), (F.col("kwh") / 50).alias("peak_kw"), family.alias("family_key"),
    )
    versions = values(spark, [(1, "demand", "2020-01-01", "approved"), (2, "credit", "2020-01-01", "approved"), (3, "average", "2020-01-01", "approved")], "version_id bigint, family_key string, effective_start string, status string")
    charges = values(spark, _KINDS, "charge_id bigint, version_id bigint, charge_type string, charge_label string, rate_value double, rate_unit string, tou_period string")
    charges = charges.withColumns({c: F.lit(None).cast("double") for c in ("tier_min", "tier_max")}).withColumns({c: F.lit(None).cast("string") for c in ("season", "customer_class")})
    billed = billing.bills(usage, versions, charges.withColumn("confidence_score", F.lit(1.0)), places=6)
    return billed.join(usage.select("usage_id", "user_id", "week"), "usage_id").select(
        "user_id", F.col("week").cast("string").alias("week"), "family_key", F.round("energy_subtotal", 4).alias("energy_subtotal"), F.round("total", 4).alias("total"), "n_lines"
    )
