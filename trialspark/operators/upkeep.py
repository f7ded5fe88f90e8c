"""Exclusions kept up to date while logs arrive in parts.

Each part leaves a small state below a folder: counts per subject, runs of training drops and
break rows. The states merge, so a new part costs a pass over that part alone and never over
the logs before it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trialspark.functions.nulls import strict_sum
from trialspark.operators import exclude, prep
from trialspark.operators.ordered import run_id
from trialspark.session import settle

COUNTED_BY = [*exclude.SUBJECT_RUN, "training"]


def training_runs(log: DataFrame, order: str = "row_id") -> DataFrame:
    """Runs of equal ``order`` values of a part: first and last place, number of drops."""
    runs = run_id(prep.training_drops(log, order), "order", prep.RUN_KEYS, order)
    return runs.groupBy(*prep.LEARNER_KEYS, "condition", "order", "run").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n_tries")
    ).drop("run")


def merged_tries(runs: DataFrame) -> DataFrame:
    """``prep.training_tries`` from the runs of all parts.

    A run that goes on in the next part is one run. The parts of a learner must follow each
    other in the order of the log; interleaved ones are an error.
    """
    spans = runs.groupBy(*prep.RUN_KEYS, "part").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    before = F.lag("last").over(Window.partitionBy(*prep.RUN_KEYS).orderBy("first", "last"))
    mixed = spans.withColumn("before", before).where("before >= first").head(1)
    if mixed:
        raise ValueError(f"parts overlap in the log of subject {mixed[0]['subject']}")
    joined = run_id(runs, "order", prep.RUN_KEYS, "first")
    return joined.groupBy(*prep.LEARNER_KEYS, "condition", "run").agg(
        F.sum("n_tries").alias("n_tries")
    )


def keep_part(
    path: str, part: int, trials: DataFrame | None = None, training: DataFrame | None = None,
    breaks: DataFrame | None = None, order: str = "row_id",
) -> None:
    """Write the states of one part; a part that is written again replaces itself.

    ``trials`` may come in any parts, ``training`` and ``breaks`` in parts of the log. Subjects
    must be numbered alike in all parts.
    """
    states = {
        "counts": None if trials is None else exclude.subject_counts(trials),
        "runs": None if training is None else training_runs(training, order),
        "breaks": None if breaks is None else breaks.where(F.col("condition") == "break").select(
            "subject", "condition", "value", "event_time", order
        ),
    }
    for name, state in states.items():
        if state is not None:
            state.write.mode("overwrite").parquet(f"{path}/{name}/part={part}")


def kept(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A state over all parts, or None if no part had it."""
    try:
        return spark.read.parquet(f"{path}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """``exclude.subject_counts`` of all trials so far; a missing answer stays missing."""
    states = kept(spark, path, "counts").drop("part")
    return states.groupBy(*COUNTED_BY).agg(
        *(strict_sum(F.col(c)).alias(c) for c in states.columns if c not in COUNTED_BY)
    )


def current_exclusions(spark: SparkSession, path: str, order: str = "row_id") -> DataFrame:
    """``exclude.exclusions`` of everything that arrived so far."""
    runs, breaks = kept(spark, path, "runs"), kept(spark, path, "breaks")
    below = excessive = None
    if runs is not None:
        below = prep.below_training(prep.accuracy_of_tries(merged_tries(runs)))
    if breaks is not None:
        excessive = prep.excessive_breaks(prep.break_times(breaks.drop("part"), order))
    return exclude.exclusions(None, below, excessive, settle(current_counts(spark, path)))
