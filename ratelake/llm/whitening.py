"""Whitening of embeddings from upper-triangle column aggregates.

Spark sums the products of every pair of dimensions in one aggregation of generated expressions; the covariance is put
together from them and decomposed by LAPACK on the driver (its size is that of a vector squared, however many vectors
there are). Entries are integers, and are centred at the integer nearest to their mean before they are multiplied, so
all sums are exact and the same however the rows are dealt; what is left of the mean is taken off afterwards, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Sums in one aggregation; wider vectors than 90 entries take several.
MOST_SUMS = 4096
#: Components whose eigenvalue is below this share of the largest hold nothing but rounding and are left out.
LEAST_SHARE = 1e-12
_LARGEST = 1.7976931348623157e308


@dataclass
class Whitening:
    """n vectors with the sums of their entries; eigenvalues fall, and a column of ``vectors`` is a component."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)


def scaled(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and x: the vectors as integers, floor(1024 c) + 100000 for each entry c, without vectors that are null or hold
    null or non-finite entries. Entries beyond 2**43 or so are beyond the contract: Spark's own overflow holds for them."""
    vec = F.col(vec_col).cast("array<double>")
    fine = vec.isNotNull() & F.forall(vec, lambda c: F.coalesce(c.between(-_LARGEST, _LARGEST), F.lit(False)))
    return table.where(fine).select(F.col(id_col).alias("id"), F.transform(vec, lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _sums(rows: DataFrame, terms: list[str]) -> list[int]:
    """The sum of each of the SQL expressions over all rows, MOST_SUMS in one aggregation."""
    out: list[int] = []
    for at in range(0, len(terms), MOST_SUMS):
        out += [int(v or 0) for v in rows.selectExpr(*(f"sum({t}) AS s{i}" for i, t in enumerate(terms[at : at + MOST_SUMS]))).first()]
    return out


def fit(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> Whitening:
    """Mean, covariance and its components over all usable vectors. Vectors of another length than most (of several
    lengths as common, the longest) are not used; without any vector n is 0."""
    rows = scaled(table, id_col, vec_col)
    common_size = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if common_size is None:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    d, n = common_size["d"], common_size["n"]
    rows = rows.where(F.size("x") == d)
    sums = _sums(rows, [f"x[{i}]" for i in range(d)])
    centre = [round(Fraction(s, n)) for s in sums]
    # No entry is null any more; saying so spares every one of the sums a test in every row.
    centred = rows.select(*(F.expr(f"coalesce(x[{i}] - {c}L, 0L)").alias(f"d{i}") for i, c in enumerate(centre)))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    products = _sums(centred, [f"d{i} * d{j}" for i, j in pairs])
    left = [s - n * c for s, c in zip(sums, centre, strict=True)]
    cov = np.zeros((d, d))
    for (i, j), p in zip(pairs, products, strict=True):
        cov[i, j] = cov[j, i] = float(Fraction(n * p - left[i] * left[j], n * n))
    values, vectors = np.linalg.eigh(cov)
    return Whitening(n, sums, values[::-1].copy(), vectors[:, ::-1].copy(), float(np.trace(cov)))


def project(table: DataFrame, model: Whitening, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id_col``, deviation (squared distance of n x from the sums, null beyond 64 bits) and whitened (an array: the
    components in falling order), one row for each usable vector of the model's width; repeated rows stay."""
    keep = [k for k in range(min(components, model.width)) if model.values[k] > LEAST_SHARE * max(model.values[0], 0.0)]
    onto = model.vectors[:, keep] / np.sqrt(model.values[keep])
    n, sums = model.n, np.array(model.sums, np.int64)
    rows = scaled(table, id_col, vec_col).where(F.size("x") == model.width)
    kind = dict(table.dtypes)[id_col]
    schema = f"id {kind}, deviation bigint, whitened array<double>"
    out = common.pa_schema(table.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), len(sums)).astype(np.int64)
            # x - S/n from whole numbers: the whole part of the mean first, then its fraction.
            whole = sums // max(n, 1)
            rest = (sums - whole * n) / max(n, 1)
            white = ((x - whole).astype(np.float64) - rest) @ onto
            far = (x - whole) * n - (sums - whole * n)
            rough = (far.astype(np.float64) ** 2).sum(1)
            square = (far * far).sum(1)
            exact = [int(s) if r < 9.2e18 else None for s, r in zip(square, rough, strict=True)]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").to_pylist(), "deviation": exact, "whitened": white.tolist()}, schema=out)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id_col``, component (from 1), n, deviation, whitened, explained, identity_error: one row for each usable vector
    and component.

    Left out: null vectors, vectors with null or non-finite entries or of an uncommon length, and components without
    variance (all of them if all vectors are equal: no rows then). An empty table gives no rows. Equal eigenvalues leave
    the choice of their components to LAPACK. Null and repeated ids and repeated rows stay, and count each time.
    Other columns are not looked at. identity_error is measured over all rows, not derived from the covariance.
    """
    model = fit(table, id_col, vec_col)
    rows = project(table, model, components, id_col, vec_col)
    k = min(components, model.width)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = rows.agg(*(F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs)).first() if pairs else []
    error = max([abs(v - (i == j)) for (i, j), v in zip(pairs, found, strict=True) if v is not None], default=0.0)
    shares = F.array(*(F.lit(float(v / model.trace) if model.trace else 0.0) for v in model.values[:k])) if k else F.array().cast("array<double>")
    return rows.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
