"""What the operators of this subpackage share: stage tables, folds, batch helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 3
HELD_OUT = 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or a new local one where that is unset and so is the master."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        kept = spark.sparkContext.getCheckpointDir()
        if kept is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ratelake-"))
            kept = spark.sparkContext.getCheckpointDir()
        where = kept
    return where.rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/ratelake/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete the stage tables; call it once nothing lazy depends on them any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/ratelake")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Recent:
    """What a worker worked out lately, of about ``most`` keys at most. There are two generations: when the younger is full it becomes the older,
    whose rest goes; keys met again move to the younger. So frequent keys stay, however many rare ones pass."""

    def __init__(self, most: int) -> None:
        self.half = most // 2
        self.known: dict = {}
        self.older: dict = {}

    def full(self, new: int) -> bool:
        """Whether ``new`` more keys begin a new generation."""
        return len(self.known) + new > self.half

    def missing(self, keys: set) -> set:
        """Those of ``keys`` that have to be put into ``known`` before all of them are there."""
        new = keys.difference(self.known)
        if self.full(len(new)):
            self.known, self.older, new = {}, self.known, keys
        if self.older:
            older = self.older
            self.known.update((k, older[k]) for k in new if k in older)
            new = new.difference(older)
        return new


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, or with a number behind it, so that none of the columns ``taken`` has it (in any case)."""
    held, out, n = {t.lower() for t in taken}, name, 0
    while out.lower() in held:
        n += 1
        out = f"{name}_{n}"
    return out


def held_out(id_col: str) -> Column:
    """True for rows whose labels no model may learn from: crc32 of the id as text, mod 3, is 1 (null ids: false)."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def map_arrow(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = 512) -> DataFrame:
    """Apply ``work`` (columns as lists in, columns as lists out) to slices of at most ``rows`` rows."""
    out = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                got = work(batch.slice(at, rows).to_pydict())
                yield pa.RecordBatch.from_pydict(got, schema=out)

    return df.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
