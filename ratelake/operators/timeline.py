"""Price histories of several utilities in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of the common form, in order, with their types.
COLUMNS = {
    "utility": "string", "schedule": "string", "effective_date": "date", "rider_effective_date": "date", "representative_kwh": "double",
    "base_cents_per_kwh": "double", "rider_cents_per_kwh": "double", "all_in_cents_per_kwh": "double", "base_bill_amount": "double",
    "all_in_bill_amount": "double", "fixed_monthly_charge": "double", "rider_coverage_status": "string", "bill_coverage_status": "string",
    "timeline_kind": "string", "rider_source_kind": "string", "rider_total_source": "string", "rider_quality_flag": "string",
    "source_pdf": "string", "docket_dir": "string", "rider_source_pdf": "string", "rider_docket_dir": "string",
}


def canonical(history: DataFrame, utility: str, schedule: str, kwh: float = 1000.0) -> DataFrame:
    """One utility's ``history`` in the common form; what it does not have is null, so forms can be put together by name.

    Prices come from blended_base_cents_per_kwh, total_rider_cents_per_kwh and blended_all_in_cents_per_kwh; bills are those of
    summer, else of winter (none without a column for summer); the kind follows from bill_coverage_status, unknown for others.
    """

    def of(name: str) -> Column:
        return F.col(name) if name in history.columns else F.lit(None)

    def bill(kind: str) -> Column:
        return F.coalesce(F.col(f"summer_{kind}_bill"), of(f"winter_{kind}_bill")) if f"summer_{kind}_bill" in history.columns else F.lit(None)

    status = of("bill_coverage_status")
    made = {
        "utility": F.lit(utility), "schedule": F.lit(schedule),
        "representative_kwh": of("representative_kwh") if "representative_kwh" in history.columns else F.lit(kwh),
        "base_cents_per_kwh": of("blended_base_cents_per_kwh"), "rider_cents_per_kwh": of("total_rider_cents_per_kwh"),
        "all_in_cents_per_kwh": of("blended_all_in_cents_per_kwh"), "base_bill_amount": bill("base"), "all_in_bill_amount": bill("all_in"),
        "timeline_kind": F.when(status == "base_plus_riders", "all_in").when(status == "base_only", "base_only").otherwise("unknown"),
    }
    return history.select(*(made.get(c, of(c)).cast(t).alias(c) for c, t in COLUMNS.items()))
