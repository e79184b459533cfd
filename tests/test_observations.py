"""What bill lines imply, by hand."""

from pyspark.sql import functions as F

from ratelake.operators.observations import implied


def test_units_values_and_confidence(spark):
    rows = [
        (1, "energy_charge", 12.0, 100.0, 0.12, False), (2, "storm_recovery_charge", 3.0, None, None, True), (3, "summary_rider_adjustments", 3.0, None, None, False),
        (4, "energy_conservation_credit", -6.0, None, None, False), (5, "customer_charge", 7.0, None, None, True), (6, "clean_energy_rider", 1.5, None, None, False),
        (7, "sales_tax", 8.4, None, None, False), (8, "other", 5.0, None, None, False), (9, None, 5.0, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, k string, amount double, q double, rate double, detail boolean")
    o = implied(F.col("k"), F.col("amount"), F.col("q"), F.col("rate"), F.lit(900.0), F.lit(120.0), F.lit(10), F.lit(30), F.col("detail"))
    got = {r["id"]: tuple(r["o"]) for r in df.select("id", o.alias("o")).collect()}
    assert got == {
        1: ("dollars_per_kwh", 0.12, 0.99), 2: ("cents_per_kwh", 1.0, 0.6), 3: ("cents_per_kwh", 0.333, 0.85), 4: ("percent_of_energy_charges", 5.0, 0.95),
        5: ("fixed_monthly", 21.0, 0.75), 6: ("fixed_monthly", 1.5, 0.95), 7: ("percent_of_taxable_amount", 7.0, 0.5), 8: (None, None, 0.5), 9: (None, None, 0.5),
    }
