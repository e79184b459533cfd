"""Monthly time-of-use summaries of interval readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratelake.functions.calendar import tou_period

ZONE = "America/New_York"


def monthly_summary(points: DataFrame, keys: tuple[str, ...] = ("meter_id",), zone: str = ZONE, seconds: int = 900) -> DataFrame:
    """keys, year, month, kWh in all and by period, peak_kw, interval_count and gap_warning, in local time.

    A month between the first and last of its key is warned of if under four fifths of its intervals are there.
    ``points`` has timestamp (UTC), kwh and the keys; peak kW comes from the largest interval.
    """
    local = F.from_utc_timestamp("timestamp", zone)
    rows = points.withColumn("__local", local).withColumn("__period", tou_period(F.col("__local")))
    by_period = [F.coalesce(F.sum(F.when(F.col("__period") == p, F.col("kwh"))), F.lit(0.0)).alias(f"{p}_kwh") for p in ("on_peak", "off_peak", "discount")]
    months = rows.groupBy(*keys, F.year("__local").alias("year"), F.month("__local").alias("month")).agg(
        F.sum("kwh").alias("total_kwh"), *by_period, (F.max("kwh") * 3600 / seconds).alias("peak_kw"), F.count("*").alias("interval_count")
    )
    order = Window.partitionBy(*keys)
    expected = F.dayofmonth(F.last_day(F.make_date("year", "month", F.lit(1)))) * (86400 // seconds)
    inner = F.row_number().over(order.orderBy("year", "month")) > 1
    inner &= F.row_number().over(order.orderBy(F.desc("year"), F.desc("month"))) > 1
    return months.withColumn("gap_warning", inner & (F.col("interval_count") < 0.8 * expected))
