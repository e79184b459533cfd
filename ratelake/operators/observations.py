"""What a bill line says about the rate behind it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components billed by energy, and those billed by month.
BY_ENERGY = ("storm_recovery_charge", "summary_rider_adjustments")
BY_MONTH = ("clean_energy_rider", "customer_charge")


def implied(key: Column, amount: Column, quantity: Column, rate: Column, billed: Column, energy: Column, days: Column, total_days: Column, detail: Column) -> Column:
    """(unit, value, confidence) of a line with component ``key``; unit and value are null where nothing follows.

    Lines with a metered ``quantity`` and ``rate`` state it. Others are laid over the bill's kWh (``billed``), its energy
    charges (``energy``) or its month; a line for part of the period (``detail``) counts by its share of the days.
    """
    some_days = (days > 0) & (total_days > 0)
    stated = quantity.isNotNull() & rate.isNotNull()
    shared = F.round(F.when(detail & some_days, billed * days / total_days).otherwise(billed), 3)
    basis = F.when(key.isin(*BY_ENERGY) & (billed != 0), F.coalesce(quantity, shared))
    by_energy, monthly, part = basis != 0, key.isin(*BY_MONTH), detail & some_days
    credit, tax = (key == "energy_conservation_credit") & (energy != 0), (key == "sales_tax") & (energy != 0)

    def of(unit: str, value: Column, confidence: float | Column) -> Column:
        sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(F.lit(unit).alias("unit"), value.cast("double").alias("value"), sure.alias("confidence"))

    return (
        F.when(stated, of("dollars_per_kwh", rate, 0.99))
        .when(by_energy, of("cents_per_kwh", F.round(amount * 100.0 / basis, 3), F.when(detail, 0.6).otherwise(0.85)))
        .when(credit, of("percent_of_energy_charges", F.round(F.abs(amount) * 100.0 / energy, 3), 0.95))
        .when(monthly & part, of("fixed_monthly", F.round(amount * total_days / days, 2), 0.75))
        .when(monthly, of("fixed_monthly", F.round(amount, 2), 0.95))
        .when(tax, of("percent_of_taxable_amount", F.round(amount * 100.0 / energy, 3), 0.5))
        .otherwise(F.struct(F.lit(None).cast("string").alias("unit"), F.lit(None).cast("double").alias("value"), F.lit(0.5).alias("confidence")))
    )
