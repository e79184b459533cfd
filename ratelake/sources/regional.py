"""Readers and normalisers for regional price tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sectors by the column that holds them.
SECTORS = {"Residential": "residential", "Commercial": "commercial", "Industrial": "industrial", "Transportation": "transportation", "All Sectors": "all_sectors"}


def number(text: Column) -> Column:
    """Digits with thousands commas; null for --, NA and other text."""
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")


def read_sector_prices(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV (Year, State, a column for each sector) as rows of year, state, sector, avg_cents_per_kwh.

    Rows whose year is no number or whose state is not two letters are left out; sectors without a price stay null.
    """
    wide = spark.read.csv(path, header=True)
    rows = wide.select(F.trim("Year").try_cast("int").alias("year"), F.upper(F.trim("State")).alias("state"), *(number(F.col(f"`{c}`")).alias(s) for c, s in SECTORS.items() if c in wide.columns))
    known = rows.where(F.col("year").isNotNull() & F.col("state").rlike("^[A-Z]{2}$"))
    return known.unpivot(["year", "state"], [s for c, s in SECTORS.items() if c in wide.columns], "sector", "avg_cents_per_kwh")
