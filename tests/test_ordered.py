"""Order-dependent operators against brute force, with chunks of two rows."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from trialspark.operators import ordered, prep, schedule


def small():
    return F.shiftright(F.col("o"), 1)


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([1, 1, 2, None]))
            for i in range(200)]
    rng.shuffle(rows)
    return rows


def frame(spark, data):
    return spark.createDataFrame(data, "k string, o bigint, v bigint").repartition(5)


def by_key(data):
    ordered_rows = sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    return [(k, list(g)) for k, g in groupby(ordered_rows, key=lambda r: r[0])]


@pytest.mark.parametrize("small_chunks", [False, True])
def test_run_id(spark, data, small_chunks):
    expected = set()
    for key, group in by_key(data):
        run, last = 0, object()
        for _, o, v in group:
            run += v != last
            last = v
            expected.add((key, o, run))
    got = ordered.run_id(frame(spark, data), "v", ["k"], "o", "run",
                         chunk=small() if small_chunks else None)
    assert {(r["k"], r["o"], r["run"]) for r in got.collect()} == expected
    assert got.count() == len(data)


@pytest.mark.parametrize("small_chunks", [False, True])
def test_row_numbers_and_totals(spark, data, small_chunks):
    expected = {(k, r[1], i + 1, len(g)) for k, g in by_key(data) for i, r in enumerate(g)}
    got = ordered.row_numbers(frame(spark, data), ["k"], "o", "n",
                              small() if small_chunks else None, total="m")
    assert {(r["k"], r["o"], r["n"], r["m"]) for r in got.collect()} == expected


def test_worked_examples(spark):
    runs = spark.createDataFrame(list(enumerate([3, 3, 4, 3, 3, 5])), "o bigint, v bigint")
    assert [r[1] for r in rows_of(ordered.run_id(runs, "v", [], "o"), "o", "run")] == [
        1, 1, 2, 3, 3, 4
    ]
    seen = spark.createDataFrame(list(enumerate("babc")), "o bigint, v string")
    got = ordered.first_seen_id(seen, "v", "o", "id")
    assert [r[1] for r in rows_of(got, "o", "id")] == [1, 2, 1, 3]
    pairs = ordered.pair_number(seen, [], "o", "pair")
    assert [r[1] for r in rows_of(pairs, "o", "pair")] == [1, 1, 2, 2]


def test_unknown_order_needs_a_chunk(spark):
    df = spark.createDataFrame([("a",)], "o string")
    with pytest.raises(TypeError):
        ordered.row_numbers(df, [], "o", "n")


def test_complete(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), (None, 3, 0.9)],
                               "k string, s bigint, v double")
    got = ordered.complete(df, ["k"], "s")
    assert got.count() == 6
    assert {tuple(r) for r in got.collect()} >= {(None, 3, 0.9), ("a", 3, None)}


def sep_with_n(seps, main, n):
    """The list of trials, taken from its end, with separators between groups."""
    if len(main) <= 1:
        return list(main)
    out, rest = [], list(main)
    while rest:
        for _ in range(n):
            if rest:
                out.append(rest.pop())
        if rest:
            out += seps
    return out


@pytest.mark.parametrize("m, n, seps", [
    (5, 2, ["b"]), (130, 44, ["b"]), (1, 1, ["b"]), (6, 3, ["b", "c"]), (4, 1, []), (9, 2, ["b"]),
])
def test_interleave(spark, m, n, seps):
    df = spark.createDataFrame([(i,) for i in range(m)], "o bigint")
    got = schedule.interleave_every_n(df, [], "o", seps, n, chunk=small())
    placed = {r["position"]: r["row_kind"] or r["o"] for r in got.collect()}
    expected = sep_with_n(seps, list(range(m)), n)
    assert [placed[i] for i in range(len(placed))] == expected
    if m == 130:
        assert len(expected) == 132 and placed[44] == placed[89] == "b"


@pytest.mark.parametrize("slice_rows", [10, 1000])
def test_schedule_is_a_shuffle_with_breaks(spark, slice_rows):
    df = spark.createDataFrame([(s, i) for s in (1, 2) for i in range(100)],
                               "subject bigint, item bigint")
    got = schedule.schedule(df, n=44, slice_rows=slice_rows)
    for subject in (1, 2):
        rows = sorted(got.where(F.col("subject") == subject).collect(),
                      key=lambda r: r["position"])
        assert [r["position"] for r in rows] == list(range(102))
        assert [i for i, r in enumerate(rows) if r["row_kind"] == "break"] == [44, 89]
        items = [r["item"] for r in rows if r["row_kind"] == "trial"]
        assert sorted(items) == list(range(100)) and items != list(range(100))


def test_hot_and_plain_schedules_agree(spark):
    df = spark.createDataFrame([(1, i) for i in range(300)], "subject bigint, item bigint")
    a, b = (rows_of(schedule.schedule(df, slice_rows=h), "position", "row_kind") for h in (1, 999))
    assert a == b


def test_pairs_of_an_odd_number_of_breaks(spark):
    log = spark.createDataFrame(
        [(1, "break", "Start", 0, 1), (1, "break", "End", 61_005, 2),
         (1, "break", "Start", 99_000, 3), (2, "trial", "Start", 5, 4)],
        "subject bigint, condition string, value string, event_time bigint, row_id bigint",
    )
    got = {r["break_number"]: (r["break_time"], r["duration"])
           for r in prep.break_times(log).collect()}
    assert got == {1: ("01:01.005", 61_005), 2: (None, None)}
