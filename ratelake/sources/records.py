"""Raw regional records, all of text, as typed rows: one table of fields for each kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text that stands for no number, and for each kind of record its fields (name, names in the raw record, type).
MISSING = ("", "--", "NA", "N/A", "Not Available")
_STATE = ("stateId", "stateID", "stateid", "state")
KINDS: dict[str, Sequence[tuple[str, tuple[str, ...], str]]] = {
    "retail-sales": (
        ("state", ("stateid",), "code"), ("state_name", ("stateDescription",), "text"), ("sector", ("sectorid",), "code"), ("sector_name", ("sectorName",), "text"),
        ("sales_million_kwh", ("sales",), "number"), ("revenue_million_dollars", ("revenue",), "number"), ("price_cents_per_kwh", ("price",), "number"), ("customers", ("customers",), "whole"),
    ),
    "generation-by-fuel": (
        ("state", ("location",), "code"), ("sector", ("sectorid",), "text"), ("fuel_type", ("fueltypeid",), "code"), ("fuel_type_name", ("fuelTypeDescription", "type-name"), "text"),
        ("generation_thousand_mwh", ("generation",), "number"),
    ),
    "state-profile-summary": (
        ("state", _STATE[:3], "code"), ("state_name", ("stateDescription",), "text"), ("net_summer_capacity_mw", ("net-summer-capacity",), "number"), ("net_generation_mwh", ("net-generation",), "number"),
        ("total_retail_sales_mwh", ("total-retail-sales",), "number"), ("average_retail_price_cents_per_kwh", ("average-retail-price",), "number"), ("co2_thousand_metric_tons", ("carbon-dioxide",), "number"),
        ("net_summer_capacity_rank", ("net-summer-capacity-rank",), "whole"), ("net_generation_rank", ("net-generation-rank",), "whole"),
        ("total_retail_sales_rank", ("total-retail-sales-rank",), "whole"), ("average_retail_price_rank", ("average-retail-price-rank",), "whole"),
    ),
    "source-disposition": (
        ("state", ("state", "stateid"), "code"), ("state_name", ("stateDescription",), "text"), ("total_net_generation_mwh", ("total-net-generation",), "number"), ("total_supply_mwh", ("total-supply",), "number"),
        ("retail_sales_mwh", ("total-elect-indust",), "number"), ("net_interstate_trade_mwh", ("net-interstate-trade",), "number"), ("estimated_losses_mwh", ("estimated-losses",), "number"), ("direct_use_mwh", ("direct-use",), "number"),
    ),
    "capability": (
        ("state", _STATE, "code"), ("energy_source", ("energysourceid",), "code"), ("producer_type", ("producertypeid",), "code"), ("net_summer_capacity_mw", ("capability",), "number"),
    ),
}


def period_parts(period: Column) -> tuple[Column, Column]:
    """(year, month) of 2024, 2024-06 or 2024-Q2, the month null for years and quarters, both for anything else."""
    year = F.regexp_extract(period, r"^(\d{4})(?:-\d{2}|-Q\d)?$", 1)
    return F.nullif(year, F.lit("")).cast("int"), F.nullif(F.regexp_extract(period, r"^\d{4}-(\d{2})$", 1), F.lit("")).cast("int")


def normalise(records: DataFrame, kind: str, frequency: str = "annual", batch: str | None = None) -> DataFrame:
    """``records`` of one of KINDS as dataset, frequency, period, year, month, the kind's fields and batch_id.

    Of several names of a field the first with a value counts; names that the records do not have are null. Codes are upper
    case and '' where missing; a number is null where its text is one of MISSING or no number; whole numbers lose their fraction.
    Generation also comes in MWh. Columns that a kind does not name are dropped.
    """
    there = set(records.columns)

    def raw(names: tuple[str, ...]) -> Column:
        found = [F.col(f"`{n}`").cast("string") for n in names if n in there]
        return F.coalesce(*(F.nullif(c, F.lit("")) for c in found)) if found else F.lit(None).cast("string")

    def typed(names: tuple[str, ...], as_what: str) -> Column:
        value = raw(names)
        if as_what == "code":
            return F.upper(F.coalesce(value, F.lit("")))
        if as_what == "text":
            return value
        plain = F.trim(value)
        number = F.when(~plain.isin(*MISSING), plain.try_cast("double"))
        return number if as_what == "number" else number.cast("bigint")

    period = F.trim(F.coalesce(raw(("period",)), F.lit("")))
    year, month = period_parts(period)
    out = records.select(
        F.lit(kind).alias("dataset"), F.lit(frequency).alias("frequency"), period.alias("period"), year.alias("year"), month.alias("month"),
        *(typed(names, t).alias(name) for name, names, t in KINDS[kind]), F.lit(batch).cast("string").alias("batch_id"),
    )
    if kind == "generation-by-fuel":
        out = out.withColumn("generation_mwh", F.col("generation_thousand_mwh") * 1000)
    return out
