"""Stage tables: rows written once to the folder that all machines share, so that rounds do not repeat what came before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .graph import checkpoint_folder


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the checkpoint folder and read back; computed once, unlike ``checkpoint()``."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stages/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
