"""Queries over bills: what lines imply, how a bill grows over the years, text put together from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratelake.operators.asof import asof_join
from ratelake.operators.latest import first_of
from ratelake.operators.observations import implied

from .registry import query, table

_COMPONENTS = ("sales_tax", "energy_charge", "storm_recovery_charge", "energy_conservation_credit", "customer_charge")
_COMPONENT_SQL = "CASE l_linenumber % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_COMPONENTS)) + " END"


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber, {_COMPONENT_SQL} AS k, l_extendedprice AS amount, l_quantity AS q, l_tax AS rate, l_returnflag = 'R' AS detail, l_linenumber * 3 + 1 AS days FROM lineitem),
    b AS (SELECT *, sum(CASE WHEN k = 'energy_charge' THEN q END) OVER w AS billed, coalesce(sum(CASE WHEN k = 'energy_charge' AND NOT detail THEN amount END) OVER w, 0) AS energy FROM i WINDOW w AS (PARTITION BY l_orderkey)),
    x AS (SELECT *, CASE WHEN k = 'storm_recovery_charge' AND billed <> 0 THEN CASE WHEN detail THEN round(billed * days / 30, 3) ELSE round(billed, 3) END END AS basis FROM b),
    o AS (SELECT l_orderkey, l_linenumber, k AS component,
        CASE WHEN k = 'energy_charge' THEN 'dollars_per_kwh' WHEN basis <> 0 THEN 'cents_per_kwh' WHEN k = 'energy_conservation_credit' AND energy <> 0 THEN 'percent_of_energy_charges' WHEN k = 'customer_charge' THEN 'fixed_monthly' WHEN k = 'sales_tax' AND energy <> 0 THEN 'percent_of_taxable_amount' END AS unit,
        CASE WHEN k = 'energy_charge' THEN rate WHEN basis <> 0 THEN round(amount * 100.0 / basis, 3) WHEN k = 'energy_conservation_credit' AND energy <> 0 THEN round(abs(amount) * 100.0 / energy, 3)
            WHEN k = 'customer_charge' AND detail THEN round(amount * 30 / days, 2) WHEN k = 'customer_charge' THEN round(amount, 2) WHEN k = 'sales_tax' AND energy <> 0 THEN round(amount * 100.0 / energy, 3) END AS value,
        CASE WHEN k = 'energy_charge' THEN 0.99 WHEN basis <> 0 AND detail THEN 0.6 WHEN basis <> 0 THEN 0.85 WHEN k = 'energy_conservation_credit' AND energy <> 0 THEN 0.95 WHEN k = 'customer_charge' AND detail THEN 0.75 WHEN k = 'customer_charge' THEN 0.95 ELSE 0.5 END AS confidence FROM x)
    SELECT component, unit, CAST(confidence AS DOUBLE) AS confidence, count(*) AS n, CAST(round(sum(value), 1) AS DOUBLE) AS total FROM o GROUP BY 1, 2, 3""")
def observation_derivation(spark: SparkSession, d: str) -> DataFrame:
    """Unit, value and confidence that each bill line implies, added up by component."""
    component = F.element_at(F.array(*map(F.lit, _COMPONENTS)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", component.alias("k"), F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("rate"),
        (F.col("l_returnflag") == "R").alias("detail"), (F.col("l_linenumber") * 3 + 1).alias("days"),
    )
    bill = Window.partitionBy("l_orderkey")
    is_energy = F.col("k") == "energy_charge"
    rows = rows.withColumns({"billed": F.sum(F.when(is_energy, F.col("q"))).over(bill), "energy": F.coalesce(F.sum(F.when(is_energy & ~F.col("detail"), F.col("amount"))).over(bill), F.lit(0.0))})
    metered = F.when(is_energy, F.col("q"))
    seen = implied(F.col("k"), F.col("amount"), metered, F.when(is_energy, F.col("rate")), F.col("billed"), F.col("energy"), F.col("days"), F.lit(30), F.col("detail"))
    out = rows.select(F.col("k").alias("component"), seen.alias("o"))
    return out.groupBy("component", F.col("o.unit").alias("unit"), F.col("o.confidence").alias("confidence")).agg(F.count("*").alias("n"), F.round(F.sum("o.value"), 1).alias("total"))


@query("""WITH v AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS a, o_totalprice AS p FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1),
    f AS (SELECT o_custkey, min(a) AS first, arg_min(p, a) AS first_p FROM v GROUP BY 1),
    m AS (SELECT o_custkey, first_p, CAST(unnest(generate_series(date_trunc('month', first), DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS month FROM f),
    b AS (SELECT m.o_custkey, month, 14 + coalesce(p, first_p) / 1000 AS bill FROM m ASOF LEFT JOIN v ON m.o_custkey = v.o_custkey AND m.month >= v.a)
    SELECT o_custkey, CAST(month AS VARCHAR) AS month, round(bill, 6) AS bill, round((bill / lag(bill, 12) OVER (PARTITION BY o_custkey ORDER BY month) - 1) * 100, 4) AS yoy_pct FROM b""")
def yoy_escalation(spark: SparkSession, d: str) -> DataFrame:
    """The bill of one constant usage in every month since the first version, and its change on a year before."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("a"), F.col("o_totalprice").alias("p"))
    versions = first_of(orders, ["o_custkey", "a"], [F.desc("o_orderkey")]).select("o_custkey", "a", "p")
    last = F.lit("2001-12-01").cast("date")
    firsts = versions.groupBy("o_custkey").agg(F.trunc(F.min("a"), "month").alias("first"), F.min_by("p", "a").alias("first_p")).where(F.col("first") <= last)
    months = firsts.select("o_custkey", "first_p", F.explode(F.sequence("first", last, F.expr("interval 1 month"))).alias("month"))
    bill = F.lit(14) + F.coalesce("p", "first_p") / 1000
    rows = asof_join(months, versions, ["o_custkey"], "month", "a").select("o_custkey", "month", bill.alias("bill"))
    before = F.lag("bill", 12).over(Window.partitionBy("o_custkey").orderBy("month"))
    return rows.select("o_custkey", F.col("month").cast("string").alias("month"), F.round("bill", 6).alias("bill"), F.round((F.col("bill") / before - 1) * 100, 4).alias("yoy_pct"))


@query("""WITH r AS (SELECT conv_id, turn, turn // 6 AS section, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role DESC NULLS LAST, text DESC NULLS LAST) = 1)
    SELECT conv_id, section, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (text <> ''), '') AS text, count(*) AS page_count,
        array_to_string(list_filter(range(section * 6, section * 6 + 6), lambda x: NOT list_contains(list(turn), x)), ',') AS missing_pages FROM r GROUP BY 1, 2""")
def section_text_assembly(spark: SparkSession, d: str) -> DataFrame:
    """The text of each section of six pages, from the last version of each page, and the pages that are missing."""
    pages = first_of(table(spark, d, "conversations"), ["conv_id", "turn"], [F.desc_nulls_last("role"), F.desc_nulls_last("text")])
    # At most six pages a section.
    held = pages.groupBy("conv_id", F.expr("turn div 6").alias("section")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("pages"))
    texts = F.filter(F.col("pages.text"), lambda t: t.isNotNull() & (t != ""))
    missing = F.array_except(F.sequence(F.col("section") * 6, F.col("section") * 6 + 5), F.col("pages.turn"))
    return held.select(
        "conv_id", "section", F.array_join(texts, "\n\n").alias("text"), F.size("pages").cast("bigint").alias("page_count"),
        F.array_join(missing.cast("array<string>"), ",").alias("missing_pages"),
    )
