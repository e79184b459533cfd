"""Work that was claimed and never finished: found again by timers over a stream of events, and in the same way over a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

CLAIM, END = "claim", ("done", "failed", "release")
#: What is said of a claim that timed out: back to the queue, or given up after so many tries.
REQUEUE, GIVE_UP = "requeued", "gave_up"
_OUT = "job string, claimed_at timestamp, stale_at timestamp, tries int, action string"


def stale_claims_batch(events: DataFrame, minutes: int, most_tries: int = 3, until: str | None = None) -> DataFrame:
    """job, claimed_at, stale_at, tries and action for each claim that nothing followed within ``minutes``.

    ``events`` has job, kind (claim, or done, failed, release, which end a claim; others are ignored) and at. A claim that
    follows a claim in time takes its place; one at the same moment as an end comes after it. tries counts the stale claims of a
    job so far; from ``most_tries`` on it is given up. ``until`` is the time up to which is known what happened (the
    last event, if not given): later stale_at are left out. Rows without a job or time are ignored.
    """
    rows = events.where(F.col("job").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(CLAIM, *END))
    turn = F.when(F.col("kind") == CLAIM, 1).otherwise(0)
    line = Window.partitionBy("job").orderBy("at", turn)
    stale_at = F.col("at") + F.make_dt_interval(mins=F.lit(minutes))
    follows = rows.withColumn("next", F.lead("at").over(line)).where(F.col("kind") == CLAIM)
    stale = follows.where(F.col("next").isNull() | (F.col("next") > stale_at)).select("job", F.col("at").alias("claimed_at"), stale_at.alias("stale_at"))
    end = rows.agg(F.max("at").alias("until")) if until is None else rows.sparkSession.range(1).select(F.lit(until).cast("timestamp").alias("until"))
    known = stale.join(F.broadcast(end), F.lit(True)).where(F.col("stale_at") < F.col("until"))  # one row
    tries = F.row_number().over(Window.partitionBy("job").orderBy("claimed_at"))
    return known.select("job", "claimed_at", "stale_at", tries.alias("tries"), F.when(tries >= most_tries, GIVE_UP).otherwise(REQUEUE).alias("action"))


def stale_claims_stream(events: DataFrame, minutes: int, most_tries: int = 3, late: str = "0 seconds") -> DataFrame:
    """``stale_claims_batch`` over a stream: a job's open claim and its tries are its state, and a timer in event time goes off
    once the watermark (``late`` behind the last event) has passed the time at which the claim is stale.

    State is dropped with the end of a claim that never was stale, and once a job is given up. Events that come later than the watermark are dropped by Spark.
    """
    span = pd.Timedelta(minutes=minutes)

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        claimed, tries = state.get if state.exists else (None, 0)
        claimed = None if claimed is None or pd.isna(claimed) else pd.Timestamp(claimed)
        out = []

        def give(at: pd.Timestamp) -> None:
            nonlocal tries
            tries += 1
            out.append((key[0], at, at + span, tries, GIVE_UP if tries >= most_tries else REQUEUE))

        if state.hasTimedOut:
            if claimed is not None:
                give(claimed)
            claimed = None
        else:
            rows = [(pd.Timestamp(at), kind == CLAIM) for f in frames for at, kind in zip(f["at"], f["kind"], strict=True)]
            for at, claims in sorted(rows):
                if claimed is not None and at > claimed + span:
                    give(claimed)
                claimed = at if claims else None
        if claimed is None and not tries:
            if state.exists:
                state.remove()
        else:
            state.update((claimed, tries))
            if claimed is not None:
                due = int((claimed + span).timestamp() * 1000)
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job", "claimed_at", "stale_at", "tries", "action"])

    known = events.where(F.col("job").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(CLAIM, *END)).select("job", "kind", "at").withWatermark("at", late)
    return known.groupBy("job").applyInPandasWithState(work, _OUT, "claimed timestamp, tries int", "append", GroupStateTimeout.EventTimeTimeout)
