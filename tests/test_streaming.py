"""The online criterion against the one over the finished log."""

import random

from pyspark.sql import functions as F

from trialspark import schemas as S
from trialspark.operators import prep
from trialspark.streaming import gate

SCHEMA = "subject bigint, condition string, trial bigint, is_correct boolean, row_id bigint, note string"


def drops(seed=3, subjects=12):
    rng, rows = random.Random(seed), []
    for subject in [None, *range(subjects)]:
        for block in ["trial_train_rep00", "other", *S.TRAINING_BLOCKS[: rng.randint(1, 5)]]:
            for trial in range(10):
                for _ in range(rng.randint(1, 3)):
                    right = rng.random() < 0.5 + 0.05 * (subject or 0)
                    rows.append((subject, block, trial, right, len(rows), "x"))
    rows += [(1, S.TRAINING_BLOCKS[0], 99, True, None, "no place"), (2, None, 1, True, len(rows) + 5, None)]
    return rows


def follow(spark, folder):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    gate.follow_gate(stream, f"{folder}/firsts", f"{folder}/state", once=True).awaitTermination()
    return sorted(map(tuple, gate.current_gate(spark, f"{folder}/firsts").collect()), key=str)


def test_parts_out_of_order_equal_the_whole_log(spark, tmp_path):
    """Later drops of a trial arrive first; every part's gate is that of what has arrived."""
    rows = spark.createDataFrame(drops(), SCHEMA)
    folder, so_far = str(tmp_path), None
    for part in (2, 0, 1):
        own = rows.where(F.coalesce(F.col("row_id") % 3, F.lit(0)) == part)
        own.repartition(3).write.mode("append").parquet(f"{folder}/in")
        so_far = own if so_far is None else so_far.union(own)
        assert follow(spark, folder) == sorted(map(tuple, prep.training_gate(so_far).collect()), key=str)
    again = follow(spark, folder)  # nothing new
    assert again == sorted(map(tuple, prep.training_gate(rows).collect()), key=str) and len(again) == 13


def test_no_drop_of_a_block_gives_an_empty_gate(spark, tmp_path):
    rows = spark.createDataFrame([(1, "other", 1, True, 1, "x")], SCHEMA)
    rows.write.parquet(f"{tmp_path}/in")
    assert follow(spark, str(tmp_path)) == []


def test_first_drops_of_a_table_are_those_of_the_gate(spark):
    rows = spark.createDataFrame(drops(5), SCHEMA)
    assert sorted(map(tuple, prep.training_gate(gate.first_drops(rows)).collect()), key=str) == sorted(
        map(tuple, prep.training_gate(rows).collect()), key=str
    )
