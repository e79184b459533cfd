"""Readers for metered usage: interval or monthly rows from JSON, CSV and XML, any number of files at once.

Interval readers return file, timestamp (UTC), kwh and kw; monthly readers return file, monthly_kwh and peak_kw.
Rows without a timestamp or a value are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTERVAL = "timestamp string, kwh double, kw double"
MONTHLY = "monthly_kwh double, peak_kw double"


def _file() -> Column:
    return F.col("_metadata.file_path").alias("file")


def to_kwh(value: Column, multiplier: Column, unit: Column) -> Column:
    """Raw readings scaled by a power of ten; unit 72 is Wh and 73 is kWh; of unknown units large values are Wh."""
    scaled = value * F.pow(F.lit(10.0), F.coalesce(multiplier, F.lit(0)))
    return F.when(unit == 72, scaled / 1000).when(unit == 73, scaled).when(scaled > 100, scaled / 1000).otherwise(scaled)


def _timestamp(text: Column) -> Column:
    """Epoch seconds or ISO text."""
    return F.coalesce(F.timestamp_seconds(text.try_cast("bigint")), F.try_to_timestamp(text))


def read_interval_json(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold a JSON list of intervals."""
    rows = spark.read.schema(INTERVAL).json(path, multiLine=True)
    return _intervals(rows.select(_file(), "timestamp", "kwh", "kw"))


def read_interval_csv(spark: SparkSession, path: str) -> DataFrame:
    """Files with a header and the columns timestamp, kwh and maybe kw, in any order."""
    names = spark.read.csv(path, header=True).columns
    kw = F.col("kw").try_cast("double") if "kw" in names else F.lit(None).cast("double")
    return _intervals(spark.read.csv(path, header=True).select(_file(), "timestamp", F.col("kwh").try_cast("double").alias("kwh"), kw.alias("kw")))


def read_monthly_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MONTHLY).json(path, multiLine=True).select(_file(), "monthly_kwh", "peak_kw").where("monthly_kwh IS NOT NULL")


def read_monthly_csv(spark: SparkSession, path: str) -> DataFrame:
    names = spark.read.csv(path, header=True).columns
    peak = F.col("peak_kw").try_cast("double") if "peak_kw" in names else F.lit(None).cast("double")
    return spark.read.csv(path, header=True).select(_file(), F.col("monthly_kwh").try_cast("double").alias("monthly_kwh"), peak.alias("peak_kw")).where("monthly_kwh IS NOT NULL")


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(schema).load(path)


def read_green_button(spark: SparkSession, path: str) -> DataFrame:
    """Green Button files: readings scaled by the file's reading type, kW from the length of an interval."""
    kinds = _xml(spark, path, "ReadingType", "powerOfTenMultiplier int, uom int, intervalLength int").select(_file(), "powerOfTenMultiplier", "uom", "intervalLength")
    kinds = kinds.groupBy("file").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("powerOfTenMultiplier", "uom", "intervalLength")))
    rows = _xml(spark, path, "IntervalReading", "timePeriod struct<duration:int,start:string>, value double")
    rows = rows.select(_file(), F.col("timePeriod.start").alias("timestamp"), F.col("timePeriod.duration").alias("duration"), "value").where("value IS NOT NULL")
    met = rows.join(kinds, "file", "left").withColumn("kwh", to_kwh(F.col("value"), F.col("powerOfTenMultiplier"), F.col("uom")))
    seconds = F.coalesce("intervalLength", "duration")
    kw = F.when(seconds > 0, F.col("kwh") * 3600 / seconds)
    return _intervals(met.select("file", "timestamp", "kwh", kw.alias("kw")))


def read_simple_xml(spark: SparkSession, path: str, tag: str = "interval") -> DataFrame:
    """Elements with timestamp, kwh (or value) and kw as attributes or as children."""
    names = ("timestamp", "kwh", "kw", "value", "start", "datetime", "usage", "demand")
    rows = _xml(spark, path, tag, ", ".join(f"`{p}{n}` string" for n in names for p in ("", "_")))
    pick = lambda *some: F.coalesce(*(F.col(f"{p}{n}") for n in some for p in ("_", "")))
    number = lambda c: c.try_cast("double")
    return _intervals(rows.select(_file(), pick("timestamp", "start", "datetime").alias("timestamp"), number(pick("kwh", "value", "usage")).alias("kwh"), F.nullif(number(pick("kw", "demand")), F.lit(0.0)).alias("kw")))


def _intervals(rows: DataFrame) -> DataFrame:
    return rows.select("file", _timestamp(F.col("timestamp")).alias("timestamp"), "kwh", "kw").where("timestamp IS NOT NULL AND kwh IS NOT NULL")


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage in whatever form the files at ``path`` have, by their suffix: JSON, CSV or XML, intervals or months.

    Intervals give timestamp, kwh and kw, months monthly_kwh and peak_kw; the columns of the other kind are null. ``path`` is one file,
    or a folder or pattern of files of one suffix. Other suffixes are an error.
    """
    suffix = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    if suffix == "xml":
        return _both(_green_or_simple(spark, path))
    if suffix == "csv":
        names = {c.lower() for c in spark.read.csv(path, header=True).columns}
        return _both(read_interval_csv(spark, path) if {"timestamp", "kwh"} <= names else read_monthly_csv(spark, path))
    if suffix == "json":
        intervals, months = read_interval_json(spark, path), read_monthly_json(spark, path)
        return _both(intervals.where("timestamp IS NOT NULL")).unionByName(_both(months))
    raise ValueError("usage files are JSON, CSV or XML")


def _green_or_simple(spark: SparkSession, path: str) -> DataFrame:
    """Green Button readings; of files without any, simple intervals."""
    found = read_green_button(spark, path)
    return read_simple_xml(spark, path) if found.isEmpty() else found


def _both(rows: DataFrame) -> DataFrame:
    kinds = {"timestamp": "timestamp", "kwh": "double", "kw": "double", "monthly_kwh": "double", "peak_kw": "double"}
    return rows.select("file", *(F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
