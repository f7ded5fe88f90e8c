"""Lookup joins give the same rows whether they broadcast or shuffle."""

import pytest
from pyspark.sql import functions as F

from trialspark.operators import joins
from trialspark.session import shared_folder


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, "a", 10), (1, None, 20), (None, "a", 30), (2, "b", 40)] + [(7, "hot", 50)] * 30,
        "k bigint, s string, v bigint",
    )


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(1, "a", 0.1), (None, "a", 0.2), (7, "hot", 0.3), (9, "z", 0.4)],
                                 "k bigint, s string, x double")


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("max_bytes, operator", [(10_000, "BroadcastHashJoin"), (0, "SortMergeJoin")])
def test_lookup(spark, rows, table, max_bytes, operator, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.lookup(rows, table, ["k", "s"], max_bytes=max_bytes)
        joined.explain()
        assert operator in capsys.readouterr().out
        got = result(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(
        [(1, "a", 10, 0.1), (1, None, 20, None), (None, "a", 30, 0.2), (2, "b", 40, None)]
        + [(7, "hot", 50, 0.3)] * 30, key=str)


@pytest.mark.parametrize("max_bytes", [10_000, 0])
def test_membership(rows, table, max_bytes):
    kept = joins.keep_in(rows, table, ["k", "s"], max_bytes=max_bytes)
    dropped = joins.drop_in(rows, table, ["k", "s"], max_bytes=max_bytes)
    flagged = joins.flag_in(rows, table, ["k", "s"], "in_table", max_bytes=max_bytes)
    assert kept.count() == 32 and dropped.count() == 2
    assert result(kept.unionByName(dropped)) == result(rows)
    assert flagged.where("in_table").count() == 32 and flagged.where("not in_table").count() == 2


def test_shared_folder_is_kept(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert spark.sparkContext.getCheckpointDir() == shared_folder(spark)


def test_fold_and_unfold(spark):
    rows = [(1, "a", None), (2, None, "a"), (3, "a", "a"), (4, None, None), (5, "a", None), (None, "b", "a")]
    df = spark.createDataFrame(rows, "id int, x string, y string")
    folded, tables = joins.fold(df, {"_n": ["x", "y"]})
    assert folded.columns == ["id", "_n"] and tables["_n"].count() == 5
    assert folded.select("_n").distinct().count() == 5
    back = joins.unfold(folded, tables)
    assert back.columns == ["id", "x", "y"] and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_many_combinations_are_not_folded(spark):
    df = spark.range(3000).select("id", F.col("id").cast("string").alias("x"), F.lit("c").alias("y"))
    folded, tables = joins.fold(df, {"_x": ["x"], "_y": ["y"]}, max_bytes=1 << 13)
    assert set(folded.columns) == {"id", "x", "_y"} and list(tables) == ["_y"]
    back = joins.unfold(folded, tables)
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    long = spark.range(4).select(F.repeat(F.col("id").cast("string"), 9000).alias("x"))
    assert joins.fold(long, {"_x": ["x"]}, max_bytes=1 << 13)[1] == {}
