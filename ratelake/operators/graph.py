"""Chains of rows that each point to one other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def chains(nodes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, root and depth for ``nodes`` (node, parent): where following parents ends, and after how many steps.

    Steps double each round, so chains of length n take log2(n) rounds. Parents that are no node are roots
    themselves. Nodes on a cycle, or that lead to one, have no end: their root and depth are null. Each round's state goes to
    the checkpoint folder, so plans stay short and lost executors cost one round.
    """
    checkpoint_folder(nodes.sparkSession)
    root = F.col("parent").isNull() | (F.col("parent") == F.col("node"))
    state = nodes.select("node", F.when(root, F.col("node")).otherwise(F.col("parent")).alias("at"), F.when(root, 0).otherwise(1).cast("bigint").alias("depth"), root.alias("ended"))
    state = state.checkpoint()
    # No chain among n nodes is longer than n: what has not ended after that many steps is on a cycle, or leads to one.
    rounds = min(max_rounds, max(1, state.count()).bit_length() + 1)
    for _ in range(rounds):
        if state.where("NOT ended").isEmpty():
            break
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("ended").alias("over"))
        moved = state.where("NOT ended").join(ahead, "at", "left").select(
            "node", F.coalesce("next", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("over", F.lit(True)).alias("ended")
        )
        state = state.where("ended").unionByName(moved).checkpoint()
    return state.select("node", F.when(F.col("ended"), F.col("at")).alias("root"), F.when(F.col("ended"), F.col("depth")).alias("depth"))


def checkpoint_folder(spark: SparkSession) -> None:
    """See to it that checkpoint() has a folder: the one the session names, or a new local one where there are no other machines."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(named or _local_folder(spark.sparkContext.master))


def _local_folder(master: str) -> str:
    """Only where the session names no checkpoint folder and has no other machines, as in tests."""
    import tempfile

    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return tempfile.mkdtemp(prefix="ratelake-")
