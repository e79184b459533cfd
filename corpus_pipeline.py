"""From raw documents to packed training sequences, stage by stage.

Each stage gets what its predecessor kept. The first four return the columns of ``documents``: the first drops
documents that the quality model rejects, the second all but one document of each near-duplicate group, the third
documents that hold a benchmark item, the fourth puts markers in place of secrets. The last returns the
pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratelake.llm import common, decontaminate, packing, quality, secrets, similarity, simhash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more; the model learns from labelled documents among ``docs``."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by SimHash fingerprints at most two bits apart."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, also none with other numbers, names or units."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with markers in place of secrets and n_chars to match."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("secrets", redact),
    ("packing", pack),
]

#: SQL can express neither the models nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again.

    The stage ``near_copies`` has the two bits of its operator, which leave most near copies of long texts; a second pass,
    by five-word shingles and a similarity of 0.8, follows it here.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name == "near_copies":
            docs = common.materialize(similarity.keep_dissimilar(docs), "pipeline-similar")
    return docs
