"""Bills for any number of usage rows in one plan.

Usage rows meet the version of their tariff family in effect, the version's charges become line items, dated
riders add theirs, and line items add up to bills. Amounts are rounded line by line (to ``places``), then summed. Charges of one
usage row are read together after a single shuffle by usage row; families, versions, charges and links are
joined by key, so Spark broadcasts them while they are small.

Columns expected: families(family_key), versions(version_id, family_key, effective_start, status),
charges(charge_id, version_id, charge_type, charge_label, rate_value, rate_unit, tier_min, tier_max, tou_period,
season, customer_class, confidence_score), rider_links(rider_family_key, applies_to_family_key, mandatory,
enrollment_type, effective_start, effective_end), usage(usage_id, family_key, customer_class, service_date,
monthly_kwh and the demand and time-of-use columns below). Missing usage columns count as null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratelake.functions.calendar import engine_season
from ratelake.functions.rates import class_matches, in_dollars, is_demand_unit, label_class
from ratelake.operators.asof import select_version
from ratelake.operators.latest import first_of

DEMAND = ("peak_kw", "base_kw", "on_peak_kw", "mid_peak_kw", "off_peak_kw", "kvar_kvar")
TOU = ("on_peak", "off_peak", "discount", "super_off_peak", "shoulder", "mid_peak")
KEY = "usage_id"


def complete_usage(usage: DataFrame) -> DataFrame:
    """``usage`` with every optional column, null where it was not given; residential without a class."""
    wanted = ["monthly_kwh", *DEMAND, *(f"{p}_kwh" for p in TOU)]
    out = usage.withColumns({c: F.lit(None).cast("double") for c in wanted if c not in usage.columns})
    if "service_date" not in usage.columns:
        out = out.withColumn("service_date", F.lit(None).cast("date"))
    own = F.col("customer_class") if "customer_class" in usage.columns else F.lit(None).cast("string")
    return out.withColumn("customer_class", F.coalesce(own, F.lit("residential")))


def demand_quantity(label: Column, unit: Column) -> Column:
    """The kW (or kVAr) that a charge's label asks for, peak demand where that is not given."""
    low = F.lower(F.coalesce(label, F.lit("")))
    has = lambda word: F.contains(low, F.lit(word))
    return (
        F.when(F.contains(F.lower(F.coalesce(unit, F.lit(""))), F.lit("kvar")), F.col("kvar_kvar"))
        .when(has("mid-peak"), F.coalesce("mid_peak_kw", "peak_kw"))
        .when(has("on-peak"), F.coalesce("on_peak_kw", "peak_kw"))
        .when(has("off-peak"), F.coalesce("off_peak_kw", "peak_kw"))
        .when(has("base demand"), F.coalesce("base_kw", "peak_kw"))
        .otherwise(F.col("peak_kw"))
    )


def tou_quantity(period: Column) -> Column:
    return reduce(lambda out, p: F.when(period == p, F.col(f"{p}_kwh")).otherwise(out), TOU, F.lit(None).cast("double"))


def resolve_versions(requests: DataFrame, versions: DataFrame, as_of: str) -> DataFrame:
    """The version of ``family_key`` for each request (all rows and columns kept), as the engine selects it."""
    some = versions.select("family_key", "version_id", "effective_start", F.coalesce("status", F.lit("approved")).alias("__status"))
    out = select_version(requests, some, ["family_key"], as_of, "effective_start", ["version_id"], F.col("__status") == "approved")
    return out.drop("__status")


def base_lines(usage: DataFrame, versions: DataFrame, charges: DataFrame, as_of: str = "service_date", places: int = 2) -> DataFrame:
    """Line items of each usage row's own schedule: usage_id, source, charge fields, quantity and amount.

    Minimum charges stay in as rows without an amount, for ``bills``.
    """
    return _own_lines(_with_version(usage, versions, as_of), charges, places)


def _with_version(usage: DataFrame, versions: DataFrame, as_of: str) -> DataFrame:
    """Usage rows with their version_id, null where the family has none."""
    chosen = resolve_versions(usage.select(KEY, "family_key", as_of), versions, as_of).select(KEY, "version_id").dropDuplicates([KEY])
    return usage.join(chosen, KEY, "left")


def _own_lines(usage: DataFrame, charges: DataFrame, places: int) -> DataFrame:
    rows = usage.join(charges.drop("family_key"), "version_id")
    season = engine_season(F.col("service_date"))
    own_class = F.coalesce(F.when(F.col("customer_class_c") != "", F.col("customer_class_c")), label_class(F.col("charge_label")))
    in_season = F.coalesce((F.col("season") == "all_year") | (F.col("season") == "") | (F.col("season") == season), F.lit(True))
    return _amounts(rows.where(in_season & class_matches(own_class, F.col("customer_class"))), places)


def _amounts(rows: DataFrame, places: int) -> DataFrame:
    bill = Window.partitionBy(KEY)
    kind, rate = F.col("charge_type"), F.coalesce("rate_value", F.lit(0.0))
    is_kind = lambda name: kind == name
    # Fixed: exact class, else generic, else all; the first that is no three-phase surcharge.
    rank = F.when(F.col("customer_class_c") == F.col("customer_class"), 0).when(F.coalesce(F.col("customer_class_c"), F.lit("all")) == "all", 1).otherwise(2)
    rows = rows.withColumn("__fixed_rank", F.when(is_kind("fixed"), rank))
    rows = rows.withColumns(
        {
            "__best_fixed": F.min("__fixed_rank").over(bill),
            "__has_tou": F.max(is_kind("tou_energy")).over(bill),
            "__has_tiers": F.max(is_kind("energy_block") & F.col("tier_max").isNotNull()).over(bill),
            "__tou_rate": F.avg(F.when(is_kind("tou_energy"), rate)).over(bill),
        }
    )
    usable = is_kind("fixed") & (F.col("__fixed_rank") == F.col("__best_fixed")) & ~F.contains(F.coalesce("charge_label", F.lit("")), F.lit("Three-Phase"))
    rows = rows.withColumn("__usable", F.when(is_kind("fixed"), usable).otherwise(True))
    order = [F.coalesce("tier_min", F.lit(0.0)), F.col("tier_max").asc_nulls_last(), "charge_id"]
    tier = Window.partitionBy(KEY, "charge_type").orderBy(*order)
    same = Window.partitionBy(KEY, "charge_type", "charge_label", rate, "season").orderBy("charge_id")
    low, kwh = F.coalesce("tier_min", F.lit(0.0)), F.col("monthly_kwh")
    width = F.greatest(F.lit(0.0), F.when(F.col("tier_max").isNull(), kwh - low).otherwise(F.col("tier_max") - low))
    rows = rows.withColumns(
        {
            "__fixed_place": F.row_number().over(Window.partitionBy(KEY, "charge_type", "__usable").orderBy("charge_id")),
            "__tier_place": F.row_number().over(tier),
            "__taken": F.coalesce(F.sum(F.when(is_kind("energy_block"), width)).over(tier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "__copy": F.row_number().over(same),
        }
    )
    has_tou_input = reduce(lambda a, b: a | b, (F.col(f"{p}_kwh").isNotNull() for p in TOU))
    first_charge = F.row_number().over(Window.partitionBy(KEY, "charge_type").orderBy("charge_id"))
    rows = rows.withColumns({"__tou_input": has_tou_input, "__first": first_charge})
    block = F.when(F.col("__has_tiers"), F.least(width, F.greatest(kwh - F.col("__taken"), F.lit(0.0)))).otherwise(F.when(F.col("__tier_place") == 1, kwh))
    asked = demand_quantity(F.col("charge_label"), F.col("rate_unit"))
    unit = F.lower(F.coalesce("rate_unit", F.lit("$/kWh")))
    per_bill = F.contains(unit, F.lit("bill")) | F.contains(unit, F.lit("month"))
    quantity = (
        F.when(is_kind("fixed"), F.when(F.col("__usable") & (F.col("__fixed_place") == 1), 1.0))
        .when(is_kind("energy_block"), F.when(~F.col("__has_tou"), block))
        .when(is_kind("tou_energy"), F.when(F.col("__tou_input"), tou_quantity(F.col("tou_period"))).when(F.col("__first") == 1, kwh))
        .when(is_kind("demand"), F.when(F.col("__copy") == 1, asked))
        .when(is_kind("adjustment"), F.when(per_bill, 1.0).when(is_demand_unit(F.col("rate_unit")), asked).otherwise(kwh))
        .when(is_kind("credit"), F.when(is_demand_unit(F.col("rate_unit")), asked).when(F.contains(F.lower(F.coalesce("rate_unit", F.lit(""))), F.lit("kwh")), kwh).otherwise(1.0))
        .when(is_kind("minimum"), F.when(~is_demand_unit(F.col("rate_unit")), 1.0))
    )
    rows = rows.withColumn("quantity", quantity)
    # Demand, credit, minimum and the average of time-of-use rates are taken as they are, without cents.
    money = F.when(is_kind("energy_block") | is_kind("adjustment") | (is_kind("tou_energy") & F.col("__tou_input")), in_dollars(rate, F.col("rate_unit")))
    money = money.when(is_kind("tou_energy"), F.col("__tou_rate")).otherwise(rate)
    amount = F.when(is_kind("credit"), -F.abs(F.col("quantity") * money)).when(is_kind("minimum"), None).otherwise(F.col("quantity") * money)
    keep = F.col("quantity").isNotNull() & ~(is_kind("energy_block") & F.col("__has_tiers") & (F.col("quantity") <= 0))
    return rows.where(keep).select(
        KEY, F.col("family_key").alias("source"), "charge_id", "charge_type", "charge_label", F.col("rate_value"), "rate_unit",
        "quantity", F.round(amount, places).alias("amount"), "confidence_score",
    )


def with_class_column(charges: DataFrame) -> DataFrame:
    """Charges with their class under a name that usage does not have."""
    return charges.withColumnRenamed("customer_class", "customer_class_c")


def active_riders(usage: DataFrame, links: DataFrame, as_of: str = "service_date", opted: tuple[str, ...] = ()) -> DataFrame:
    """Riders of each usage row: mandatory or opted into, in force on the date (ends included); per rider the link that began last."""
    some = links.select(
        F.col("applies_to_family_key").alias("family_key"), F.col("rider_family_key").alias("rider"), "mandatory", "enrollment_type",
        F.col("effective_start").cast("date").alias("__start"), F.col("effective_end").cast("date").alias("__end"),
    )
    wanted = F.coalesce(F.col("mandatory"), F.lit(False)) | F.col("rider").isin(*opted) if opted else F.coalesce(F.col("mandatory"), F.lit(False))
    met = usage.select(KEY, "family_key", as_of).join(some.where(wanted), "family_key")
    day = F.col(as_of)
    live = F.coalesce(F.col("__start") <= day, F.lit(True)) & F.coalesce(F.col("__end") >= day, F.lit(True))
    return first_of(met.where(live), [KEY, "rider"], [F.col("__start").desc_nulls_last(), "enrollment_type"]).select(KEY, "rider", "mandatory", as_of)


def rider_lines(usage: DataFrame, versions: DataFrame, charges: DataFrame, links: DataFrame, base: DataFrame, as_of: str = "service_date", opted: tuple[str, ...] = (), places: int = 2) -> DataFrame:
    """Line items of the riders in force; a rider with unit %_energy takes its share of the schedule's energy lines."""
    riders = active_riders(usage, links, as_of, opted).withColumnRenamed("rider", "family_key")
    chosen = resolve_versions(riders, versions, as_of).select(KEY, "family_key", "version_id").dropDuplicates([KEY, "family_key"])
    own = charges.drop("family_key").where("charge_type = 'adjustment'")
    rows = usage.drop("family_key").join(chosen, KEY).join(own, "version_id")
    energy = base.where("charge_type IN ('energy_block', 'tou_energy')").groupBy(KEY).agg(F.round(F.sum("amount"), places).alias("energy_subtotal"))
    rows = rows.join(energy, KEY, "left").withColumn("energy_subtotal", F.coalesce("energy_subtotal", F.lit(0.0)))
    share = F.lower(F.coalesce("rate_unit", F.lit(""))) == "%_energy"
    own_class = F.coalesce(F.when(F.col("customer_class_c") != "", F.col("customer_class_c")), F.when(~share, label_class(F.col("charge_label"))))
    unit = F.lower(F.coalesce("rate_unit", F.lit("$/kWh")))
    per_bill = F.contains(unit, F.lit("bill")) | F.contains(unit, F.lit("month"))
    asked = demand_quantity(F.col("charge_label"), F.col("rate_unit"))
    quantity = F.when(share, F.col("energy_subtotal")).when(per_bill, 1.0).when(is_demand_unit(F.col("rate_unit")), asked).otherwise(F.col("monthly_kwh"))
    rate = F.coalesce("rate_value", F.lit(0.0))
    money = F.when(share, rate).otherwise(in_dollars(rate, F.col("rate_unit")))
    out = rows.where(class_matches(own_class, F.col("customer_class"))).withColumn("quantity", quantity).where("quantity IS NOT NULL")
    return out.select(
        KEY, F.col("family_key").alias("source"), "charge_id", "charge_type", "charge_label", "rate_value", "rate_unit", "quantity",
        F.round(F.col("quantity") * money, places).alias("amount"), "confidence_score",
    )


def bills(usage: DataFrame, versions: DataFrame, charges: DataFrame, links: DataFrame | None = None, as_of: str = "service_date", opted: tuple[str, ...] = (), places: int = 2) -> DataFrame:
    """One bill per usage row: base_subtotal, energy_subtotal, rider_subtotal, minimum_adjustment, total,
    source_confidence (least of the schedule's charges, 0.5 at most with unmatched time-of-use kWh), n_lines and warnings.

    Usage rows without a version or charges get zero amounts and a warning.
    """
    full, charges = complete_usage(usage), with_class_column(charges)
    full = _with_version(full, versions, as_of)
    base = _own_lines(full, charges, places)
    if links is not None:
        riders = rider_lines(full.drop("version_id"), versions, charges, links, base, as_of, opted, places)
    else:
        riders = base.limit(0)
    lines = base.withColumn("rider", F.lit(False)).unionByName(riders.withColumn("rider", F.lit(True)))
    own, extra = ~F.col("rider"), F.col("rider")
    summed = lambda cond: F.coalesce(F.round(F.sum(F.when(cond, F.col("amount"))), places), F.lit(0.0))
    is_minimum = own & (F.col("charge_type") == "minimum")
    totals = lines.groupBy(KEY).agg(
        summed(own).alias("base_subtotal"), summed(own & F.col("charge_type").isin("energy_block", "tou_energy")).alias("energy_subtotal"),
        summed(extra).alias("rider_subtotal"), F.max(F.when(is_minimum, F.col("rate_value"))).alias("__minimum"),
        F.min(F.when(own, F.col("confidence_score"))).alias("__confidence"), F.sum(F.when(F.col("amount").isNotNull(), 1).otherwise(0)).alias("n_lines"),
    )
    periods = charges.where("charge_type = 'tou_energy'").groupBy("version_id").agg(F.collect_set("tou_period").alias("periods"))
    unmatched = reduce(lambda a, b: a + b, (F.when(~F.array_contains("periods", p), F.coalesce(f"{p}_kwh", F.lit(0.0))).otherwise(0.0) for p in TOU))
    out = full.join(periods, "version_id", "left").join(totals, KEY, "left").withColumn("unmatched_kwh", F.coalesce(unmatched, F.lit(0.0)))
    for c in ("base_subtotal", "energy_subtotal", "rider_subtotal", "n_lines"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0).cast("double" if c != "n_lines" else "bigint")))
    before = F.round(F.col("base_subtotal") + F.col("rider_subtotal"), places)
    short = F.coalesce(F.greatest(F.round(F.col("__minimum") - before, places), F.lit(0.0)), F.lit(0.0))
    confidence = F.coalesce("__confidence", F.lit(1.0))
    warnings = F.array_compact(
        F.array(
            F.when(F.col("version_id").isNull(), "no tariff version"), F.when(F.col("version_id").isNotNull() & (F.col("n_lines") == 0), "no charges apply"),
            F.when(F.col("unmatched_kwh") > 0, "partial time-of-use coverage"),
        )
    )
    return out.select(
        KEY, "family_key", "version_id", "base_subtotal", "energy_subtotal", "rider_subtotal", short.alias("minimum_adjustment"), F.round(before + short, places).alias("total"),
        F.round(F.when(F.col("unmatched_kwh") > 0, F.least(confidence, F.lit(0.5))).otherwise(confidence), 3).alias("source_confidence"), "n_lines", "unmatched_kwh", warnings.alias("warnings"),
    )


def compare_schedules(usage: DataFrame, family_keys: DataFrame, versions: DataFrame, charges: DataFrame, links: DataFrame | None = None, as_of: str = "service_date", places: int = 2) -> DataFrame:
    """Each usage row billed under every family of ``family_keys`` (family_key), ranked by total; rows with unmatched
    time-of-use kWh or no base charge are left out. One row per usage row and family, so the work is their product."""
    every = usage.drop("family_key").withColumnRenamed(KEY, "for_usage").crossJoin(family_keys.select("family_key").distinct())
    every = every.withColumn(KEY, F.concat_ws("|", F.col("for_usage").cast("string"), "family_key"))
    billed = bills(every, versions, charges, links, as_of, places=places).where("unmatched_kwh = 0 AND base_subtotal > 0")
    owners = every.select(KEY, "for_usage")
    order = Window.partitionBy("for_usage").orderBy("total", "family_key")
    return billed.join(owners, KEY).withColumn("rank", F.row_number().over(order)).drop(KEY)


def flat_schedules(schedules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, charges) for ``bills`` out of parsed schedules, one nested row for each version.

    ``schedules`` has version_id, family_key, effective_start, status and arrays fixed_charges (label, rate, unit),
    energy_charges (label, rate, unit, block_from, block_to, tou_period, season) and demand_charges (label, rate, unit); null and
    empty arrays have no charges. An energy charge with a period is a time-of-use charge.
    """
    versions = schedules.select("version_id", "family_key", "effective_start", "status")
    missing = {"block_from": "double", "block_to": "double", "tou_period": "string", "season": "string"}

    def rows(name: str, kind: Column) -> DataFrame:
        some = schedules.select("version_id", F.posexplode(name).alias("at", "c")).select("version_id", F.lit(name).alias("of"), "at", "c.*")
        some = some.withColumns({k: F.lit(None).cast(t) for k, t in missing.items() if k not in some.columns})
        return some.select(
            F.xxhash64("version_id", "of", "at").alias("charge_id"), "version_id", kind.alias("charge_type"), F.col("label").alias("charge_label"), F.col("rate").cast("double").alias("rate_value"),
            F.col("unit").alias("rate_unit"), F.col("block_from").alias("tier_min"), F.col("block_to").alias("tier_max"), "tou_period", "season",
        )

    parts = [rows("fixed_charges", F.lit("fixed")), rows("energy_charges", F.when(F.col("tou_period").isNotNull(), "tou_energy").otherwise("energy_block")), rows("demand_charges", F.lit("demand"))]
    charges = reduce(DataFrame.unionByName, parts)
    return versions, charges.withColumns({"customer_class": F.lit(None).cast("string"), "confidence_score": F.lit(1.0)})
