"""Reports as files: the same rows as CSV, JSON lines and a Markdown table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, folder: str, name: str) -> dict[str, str]:
    """Write ``df`` under ``folder`` in three forms and return their paths. Spark writes the parts; the Markdown rows stand below
    a header of their own file, and cells have their bars escaped. Nested columns are written as JSON text in CSV and Markdown."""
    paths = {kind: f"{folder}/{name}.{kind}" for kind in ("csv", "json", "md")}
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
    flat.write.mode("overwrite").option("header", True).csv(paths["csv"])
    df.write.mode("overwrite").json(paths["json"])
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in flat.columns]
    lines = flat.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    head = "| " + " | ".join(flat.columns) + " |\n|" + " --- |" * len(flat.columns)
    lines.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{paths['md']}/head")
    lines.write.mode("overwrite").text(f"{paths['md']}/rows")
    return paths
