"""Runs a registered query and its SQL over the smallest tables and compares the rows."""

import math

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(value):
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return None
    return value.item() if hasattr(value, "item") and getattr(value, "ndim", 1) == 0 else value


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


def same(spark, query, sql):
    return rows(query(spark, DATA).toPandas()), rows(connect().execute(sql).df())
