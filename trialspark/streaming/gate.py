"""The training criterion while the logs arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from trialspark import schemas as S
from trialspark.operators import prep


def first_drops(
    drops: DataFrame, blocks: Sequence[str] = S.TRAINING_BLOCKS, order: str = "row_id"
) -> DataFrame:
    """First drop of each training trial, for a stream or a table.

    The state of a stream is one row per subject, block and trial, spread over all of them, and
    drops are combined before the shuffle, so a subject with many drops makes no hot task.
    Drops may come in any order; a drop without a place in the order never comes first.
    """
    kept = drops.where(F.col("condition").isin(*blocks))
    return kept.groupBy("subject", "condition", "trial").agg(
        F.min_by("is_correct", order).alias("is_correct"), F.min(order).alias(order)
    )


def follow_gate(
    drops: DataFrame, path: str, checkpoint: str,
    blocks: Sequence[str] = S.TRAINING_BLOCKS, order: str = "row_id", once: bool = False,
) -> StreamingQuery:
    """Keep the first drops of a stream below ``path``; read them with ``current_gate``.

    Every batch writes the first drops that it changed to a folder of its own number. A batch
    that is run again after a failure replaces its folder, so nothing counts twice. With
    ``once`` the stream ends when what has arrived is done; started again with the same
    ``checkpoint``, it goes on with the files that came since. Both folders must be shared.
    """

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = (
        first_drops(drops, blocks, order).writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint).foreachBatch(keep)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_gate(
    spark: SparkSession, path: str, passing: float = 0.9, max_attempts: int = 5,
    blocks: Sequence[str] = S.TRAINING_BLOCKS, order: str = "row_id",
) -> DataFrame:
    """``prep.training_gate`` of all drops that arrived so far.

    A trial's kept drops are the earliest of some batches, so the earliest of them is its first.
    """
    kept = spark.read.parquet(path).drop("batch")
    return prep.training_gate(kept, passing, max_attempts, blocks, order)
