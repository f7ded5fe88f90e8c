"""Merged states of parts against the whole logs."""

import pytest
from pyspark.sql import functions as F

from trialspark.operators import exclude, prep, upkeep
from trialspark.plans import adapters as A

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_appended_parts_equal_the_whole(spark, tmp_path):
    """Edges fall inside runs; a missing answer in one part stays missing; a part comes twice."""
    path = str(tmp_path)
    trials = A.trials(spark, SMALL).withColumn(
        "correct", F.when(F.xxhash64("subject", "item") % 50 != 0, F.col("correct"))
    )
    training, breaks = A.training_log(spark, SMALL), A.break_log(spark, SMALL)
    least, most = training.agg(F.min("row_id"), F.max("row_id")).first()
    for part in (0, 1, 1, 2):
        own = F.floor((F.col("row_id") - least) * 3 / (most - least + 1)) == part
        upkeep.keep_part(
            path, part, trials.where(F.pmod(F.xxhash64("item"), F.lit(3)) == part),
            training.where(own), breaks.where(own),
        )
    columns = exclude.subject_counts(trials).columns
    assert rows(upkeep.current_counts(spark, path).select(*columns)) == rows(exclude.subject_counts(trials))
    tries = rows(prep.training_tries(training))
    assert rows(upkeep.merged_tries(upkeep.kept(spark, path, "runs"))) == tries
    cut = [r for p in range(3) for r in rows(spark.read.parquet(f"{path}/runs/part={p}"))]
    assert len(cut) >= len(tries) > 0
    whole = exclude.exclusions(
        trials, prep.below_training(prep.session_accuracy(training)),
        prep.excessive_breaks(prep.break_times(breaks)),
    )
    assert rows(upkeep.current_exclusions(spark, path)) == rows(whole)


LOG = "subject bigint, data_source string, mask_added_tokens string, stop_at string, condition string, parameter string, sentence string, order bigint, row_id bigint"


def log(spark, cells):
    return spark.createDataFrame(
        [(s, "human", "m", "c", "trial_train_rep01", "Drop", "x", o, i) for s, o, i in cells], LOG
    )


def test_a_run_over_an_edge_is_one_run(spark, tmp_path):
    cells = [(1, 5, 0), (1, 5, 1), (1, 6, 2), (1, 5, 3), (None, 5, 4), (None, 5, 5)]
    for part, (a, b) in enumerate([(0, 1), (1, 4), (4, 5), (5, 6), (6, 6)]):
        upkeep.keep_part(str(tmp_path), part, training=log(spark, cells[a:b]))
    got = upkeep.merged_tries(upkeep.kept(spark, str(tmp_path), "runs"))
    assert rows(got) == rows(prep.training_tries(log(spark, cells)))
    assert sorted(r["n_tries"] for r in got.collect()) == [1, 1, 2, 2]


def test_parts_that_overlap_are_an_error(spark, tmp_path):
    for part in (0, 1):
        upkeep.keep_part(str(tmp_path), part, training=log(spark, [(1, 5, part), (1, 6, part + 2)]))
    with pytest.raises(ValueError, match="overlap"):
        upkeep.merged_tries(upkeep.kept(spark, str(tmp_path), "runs"))


def test_states_that_never_came(spark, tmp_path):
    assert upkeep.kept(spark, str(tmp_path), "breaks") is None
    trials = A.trials(spark, SMALL)
    upkeep.keep_part(str(tmp_path), 0, trials)
    assert rows(upkeep.current_exclusions(spark, str(tmp_path))) == rows(exclude.exclusions(trials))
