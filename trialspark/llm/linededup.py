"""Line dedup by overlapping windows, with DataFrame functions only.

Every run of ``window`` consecutive lines is hashed; a run that occurs more than once keeps its
first place, by key and position, and is removed everywhere else. A line goes if any removed run
covers it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trialspark.llm.common import settle

BLANK = " \t\r"


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is not taken."""
    lower = {c.lower() for c in taken}
    while name in lower:
        name = f"_{name}"
    return name


def bound(array: Column, use: Callable[[Column], Column]) -> Column:
    """``use(array)`` with the array worked out once, also where a lambda reads it often."""
    return F.transform(F.array(array), use)[0]


def run_hashes(lines: Column, window: int) -> Column:
    """Position and 128-bit hash of every run of lines that are not all blank."""
    hashed = F.transform(lines, lambda line: F.struct(
        F.xxhash64(line).alias("one"), F.xxhash64(F.lit(7), line).alias("two"),
        (F.trim(line, F.lit(BLANK)) != "").alias("filled"),
    ))

    def runs(known: Column) -> Column:
        def one(i: Column) -> Column:
            part = [known[i + j] for j in range(window)]
            return F.struct(
                i.alias("pos"),
                F.xxhash64(*(x["one"] for x in part)).alias("w1"),
                F.xxhash64(*(x["two"] for x in part)).alias("w2"),
                reduce(Column.__or__, (x["filled"] for x in part)).alias("filled"),
            )

        last = F.size(known) - window
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one))

    return F.filter(bound(hashed, runs), lambda run: run["filled"])


def drop_repeated_runs(
    docs: DataFrame, window: int = 3, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``docs`` with repeated runs of lines removed, and ``n_lines`` and ``n_removed`` added.

    Lines end at a line feed; ``n_lines`` counts them before removal. Documents are ordered by
    key, then by text hash where a key occurs with several texts; a repeated row is the same
    document and gets the same text as its twin. A text of fewer lines than ``window`` stays as
    it is, runs of blank lines do not count, and a text whose lines all go becomes empty. A
    missing text stays missing with 0 lines. A missing key comes before all others. Columns named like the
    two added ones are replaced; other columns stay. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    mark = fresh("text_hash", docs.columns)
    keyed = docs.select(*kept, F.xxhash64(F.col(text)).alias(mark))
    place = F.struct(F.col(key).alias("k"), F.col(mark).alias("h"), F.col("run.pos").alias("pos"))
    runs = (
        keyed.where(F.col(text).isNotNull())
        .select(key, mark, F.explode(run_hashes(F.split(F.col(text), "\n"), window)).alias("run"))
        .select(place.alias("place"), "run.w1", "run.w2")
    )
    # Partial minima and maxima are taken before the shuffle, so a very common run is one row
    # per task. They are settled, so that both sides of the join have a shuffle of their own and
    # adaptive execution can split the occurrences of a common run.
    firsts = settle(
        runs.groupBy("w1", "w2")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    )
    later = (
        runs.join(firsts, ["w1", "w2"])
        .where(~F.col("place").eqNullSafe(F.col("first"))).select("place.*")
        .groupBy("k", "h").agg(F.collect_set("pos").alias("starts"))
    )
    renamed = later.select(
        F.col("k").alias(fresh("run_key", docs.columns)), F.col("h").alias(fresh("run_hash", docs.columns)),
        F.col("starts").alias(fresh("starts", docs.columns)),
    )
    run_key, run_hash, name = renamed.columns
    lines, starts = F.split(F.col(text), "\n"), F.col(name)
    covered = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (window - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    text_left = F.array_join(
        bound(lines, lambda known: F.transform(left, lambda i: known[i])), "\n"
    )
    same = keyed[key].eqNullSafe(renamed[run_key]) & (keyed[mark] == renamed[run_hash])
    joined = keyed.join(renamed.hint("shuffle_hash"), same, "left")
    return joined.select(
        *(
            F.when(F.col(name).isNull(), F.col(text)).otherwise(text_left).alias(text)
            if c == text else F.col(c)
            for c in kept
        ),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col(name).isNull(), 0).otherwise(F.size(lines) - F.size(left)).cast("long").alias("n_removed"),
    )
