"""Hand-computed bills: tiers, seasons, time of use, demand, riders, minimum."""

from datetime import date

import pytest

from ratelake.plans import billing

CHARGE = "charge_id bigint, version_id bigint, charge_type string, charge_label string, rate_value double, rate_unit string, tier_min double, tier_max double, tou_period string, season string, customer_class string, confidence_score double"


def charge(i, version, kind, rate, unit, lo=None, hi=None, period=None, season=None, klass=None, label=None, confidence=0.9):
    return (i, version, kind, label, rate, unit, lo, hi, period, season, klass, confidence)


@pytest.fixture(scope="module")
def tables(spark):
    versions = spark.createDataFrame(
        [(1, "leaf-500", "2025-10-01", "approved"), (2, "leaf-601", "2026-01-01", "approved"), (3, "tou", "2025-01-01", "approved"), (4, "big", "2025-01-01", "approved"), (5, "low", "2025-01-01", None), (6, "recd", "2020-01-01", "approved"), (7, "leaf-500", "2025-11-01", "proposed")],
        "version_id bigint, family_key string, effective_start string, status string",
    )
    charges = spark.createDataFrame(
        [
            charge(1, 1, "fixed", 14.0, "$/month"),
            charge(2, 1, "energy_block", 12.623, "cents/kWh", 0.0, None, season="summer"),
            charge(3, 1, "energy_block", 12.623, "cents/kWh", 0.0, 800.0, season="winter"),
            charge(4, 1, "energy_block", 11.623, "cents/kWh", 800.0, None, season="winter"),
            charge(5, 2, "adjustment", 1.549, "cents/kWh", klass="residential"),
            charge(6, 3, "fixed", 14.0, "$/month"),
            charge(7, 3, "tou_energy", 0.3, "$/kWh", period="on_peak"),
            charge(8, 3, "tou_energy", 0.1, "$/kWh", period="off_peak"),
            charge(9, 4, "fixed", 22.0, "$/month", klass="general_service"),
            charge(10, 4, "fixed", 30.0, "$/month", klass="industrial"),
            charge(11, 4, "demand", 10.5, "$/kW", label="Demand"),
            charge(12, 4, "demand", 10.5, "$/kW", label="Demand"),
            charge(13, 4, "energy_block", 0.06543, "$/kWh"),
            charge(14, 5, "fixed", 5.0, "$/month"),
            charge(15, 5, "minimum", 20.0, "$/month"),
            charge(16, 5, "credit", 2.0, "$/month"),
            charge(17, 6, "adjustment", -0.05, "%_energy"),
        ],
        CHARGE,
    )
    links = spark.createDataFrame(
        [("leaf-601", "leaf-500", True, None, None, None), ("recd", "leaf-500", False, "opt", "2020-01-01", "2030-01-01"), ("recd", "low", True, None, "2020-01-01", "2020-12-31")],
        "rider_family_key string, applies_to_family_key string, mandatory boolean, enrollment_type string, effective_start string, effective_end string",
    )
    return versions, charges, links


def bill(spark, tables, rows, schema, **more):
    usage = spark.createDataFrame(rows, "usage_id bigint, family_key string, service_date date, monthly_kwh double" + schema)
    return {r["usage_id"]: r for r in billing.bills(usage, *tables, **more).collect()}


def test_seasons_tiers_and_riders(spark, tables):
    got = bill(spark, tables, [(1, "leaf-500", date(2025, 8, 1), 1000.0), (2, "leaf-500", date(2025, 1, 15), 500.0), (3, "leaf-500", date(2025, 12, 1), 1200.0)], "")
    assert got[1]["total"] == pytest.approx(14.0 + 126.23 + 15.49, abs=0.011)
    assert got[2]["total"] == pytest.approx(14.0 + 63.115 + 7.745, abs=0.02)
    assert got[3]["energy_subtotal"] == pytest.approx(800 * 0.12623 + 400 * 0.11623, abs=0.011)
    assert got[3]["version_id"] == 1  # the proposed one does not count


def test_share_of_energy_for_those_who_opted(spark, tables):
    got = bill(spark, tables, [(1, "leaf-500", date(2025, 8, 1), 1000.0)], "", opted=("recd",))
    assert got[1]["rider_subtotal"] == pytest.approx(15.49 - 6.31, abs=0.011)


def test_time_of_use(spark, tables):
    rows = [(1, "tou", date(2025, 3, 1), 1000.0, 300.0, 700.0, None), (2, "tou", date(2025, 3, 1), 1000.0, None, None, None), (3, "tou", date(2025, 3, 1), 1000.0, 300.0, 600.0, 100.0)]
    got = bill(spark, tables, rows, ", on_peak_kwh double, off_peak_kwh double, discount_kwh double")
    assert got[1]["total"] == pytest.approx(14 + 90 + 70)
    assert got[2]["total"] == pytest.approx(14 + 200)
    assert got[3]["unmatched_kwh"] == 100.0
    assert got[3]["source_confidence"] == 0.5


def test_demand_class_and_duplicates(spark, tables):
    got = bill(spark, tables, [(1, "big", date(2025, 3, 1), 5000.0, 20.0, "general_service")], ", peak_kw double, customer_class string")
    assert got[1]["total"] == pytest.approx(22 + 210 + 327.15)


def test_minimum_credit_and_expired_rider(spark, tables):
    got = bill(spark, tables, [(1, "low", date(2025, 3, 1), 10.0), (2, "nowhere", date(2025, 3, 1), 10.0)], "")
    assert (got[1]["base_subtotal"], got[1]["minimum_adjustment"], got[1]["total"], got[1]["rider_subtotal"]) == (3.0, 17.0, 20.0, 0.0)
    assert got[2]["total"] == 0.0
    assert got[2]["warnings"] == ["no tariff version"]


def test_compare(spark, tables):
    usage = spark.createDataFrame([(1, "x", date(2025, 8, 1), 1000.0)], "usage_id bigint, family_key string, service_date date, monthly_kwh double")
    families = spark.createDataFrame([("leaf-500",), ("low",), ("tou",)], "family_key string")
    got = [(r["family_key"], r["rank"]) for r in billing.compare_schedules(usage, families, *tables).orderBy("rank").collect()]
    assert got == [("low", 1), ("leaf-500", 2), ("tou", 3)]


def test_nested_schedules_bill_like_flat_ones(spark):
    kind = (
        "version_id bigint, family_key string, effective_start date, status string, fixed_charges array<struct<label:string,rate:double,unit:string>>, "
        "energy_charges array<struct<label:string,rate:double,unit:string,block_from:double,block_to:double,tou_period:string,season:string>>, demand_charges array<struct<label:string,rate:double,unit:string>>"
    )
    fixed = [("customer charge", 14.0, "$/month")]
    tiers = [("first", 12.623, "cents/kWh", 0.0, 800.0, None, "winter"), ("rest", 11.623, "cents/kWh", 800.0, None, None, "winter"), ("summer", 12.623, "cents/kWh", 0.0, None, None, "summer")]
    times = [("on", 0.3, "$/kWh", None, None, "on_peak", None), ("off", 0.1, "$/kWh", None, None, "off_peak", None)]
    schedules = spark.createDataFrame([(1, "a", date(2025, 1, 1), "approved", fixed, tiers, None), (2, "b", date(2025, 1, 1), "approved", fixed, times, [("Demand", 10.5, "$/kW")]), (3, "c", date(2025, 1, 1), "approved", None, [], None)], kind)
    versions, charges = billing.flat_schedules(schedules)
    usage = spark.createDataFrame(
        [(1, "a", date(2025, 12, 1), 1200.0, None, None, None), (2, "a", date(2025, 8, 1), 1000.0, None, None, None), (3, "b", date(2025, 3, 1), 1000.0, 300.0, 700.0, 20.0), (4, "c", date(2025, 3, 1), 10.0, None, None, None)],
        "usage_id bigint, family_key string, service_date date, monthly_kwh double, on_peak_kwh double, off_peak_kwh double, peak_kw double",
    )
    got = {r["usage_id"]: r for r in billing.bills(usage, versions, charges).collect()}
    assert got[1]["total"] == pytest.approx(14 + 800 * 0.12623 + 400 * 0.11623, abs=0.011) and got[2]["total"] == pytest.approx(14 + 126.23)
    assert got[3]["total"] == pytest.approx(14 + 90 + 70 + 210) and got[4]["warnings"] == ["no charges apply"]
