"""Order-dependent operators that survive hot keys.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task. Here the order
column is cut into chunks, the window runs per (key, chunk), and what a chunk needs from
the earlier chunks of its key (a running total, the last value) comes from a table with one
row per (key, chunk). Chunks are intervals of unique integers, so none holds more than
``CHUNK_ROWS`` rows of a key, however hot the key is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from trialspark.operators.joins import lookup

CHUNK_BITS = 20
CHUNK_ROWS = 1 << CHUNK_BITS


def order_chunk(df: DataFrame, order: str, bits: int = CHUNK_BITS) -> Column:
    """Chunk of an integer order column, or of the ``row_id`` that the log reader makes."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.StructType):
        return F.struct(
            F.col(order)["file"], F.col(order)["block"],
            F.shiftright(F.col(order)["seq"], bits),
        )
    if isinstance(kind, T.IntegralType):
        return F.shiftright(F.col(order), bits)
    raise TypeError(f"{order} is {kind.simpleString()}: pass chunk= for this order column")


def _cells(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    # One struct as the partition key: equality of structs matches NULL fields, and the
    # window and the join below then share a single shuffle.
    return df.withColumn("_cell", F.struct(*keys, chunk.alias("_chunk")))


def _across(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*(F.col("_cell")[k] for k in keys)).orderBy("_cell._chunk")


def running_total(
    df: DataFrame,
    amount: Column,
    keys: Sequence[str],
    order: str | Sequence[str],
    name: str,
    chunk: Column | None = None,
    total: str | None = None,
) -> DataFrame:
    """Running sum of ``amount`` by ``order`` within ``keys``, this row included.

    ``total`` names an optional column with the sum over the whole key.
    """
    order = [order] if isinstance(order, str) else list(order)
    chunk = order_chunk(df, order[0]) if chunk is None else chunk
    cells = _cells(df.withColumn("_amount", amount), keys, chunk)
    within = Window.partitionBy("_cell").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    across = _across(keys)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    # from the windowed rows, so that the shuffle by cell is done once
    windowed = cells.withColumn("_within", F.sum("_amount").over(within))
    sums = windowed.groupBy("_cell").agg(F.sum("_amount").alias("_sum"))
    sums = sums.select(
        "_cell",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        *(
            [F.sum("_sum").over(
                across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ).alias(total)]
            if total else []
        ),
    )
    return (
        windowed.join(sums, "_cell")
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_cell", "_amount", "_within", "_before")
    )


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    name: str,
    chunk: Column | None = None,
    total: str | None = None,
) -> DataFrame:
    """1-based position by ``order`` within ``keys``."""
    return running_total(df, F.lit(1).cast("bigint"), keys, order, name, chunk, total)


def run_id(
    df: DataFrame, value: str, keys: Sequence[str], order: str, name: str = "run",
    chunk: Column | None = None,
) -> DataFrame:
    """Number the runs of equal neighbouring values of each key, from 1."""
    cells = _cells(df, keys, order_chunk(df, order) if chunk is None else chunk)
    by_order = Window.partitionBy("_cell").orderBy(order)
    first = F.row_number().over(by_order) == 1
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(by_order))
    marked = cells.withColumn("_change", F.when(first, False).otherwise(changed).cast("bigint"))
    edges = marked.groupBy("_cell").agg(
        F.min_by(value, order).alias("_first"),
        F.max_by(value, order).alias("_last"),
        F.sum("_change").alias("_changes"),
    )
    across = _across(keys)
    edges = edges.select(
        "_cell", "_changes",
        F.when(F.row_number().over(across) == 1, True)
        .otherwise(~F.col("_first").eqNullSafe(F.lag("_last").over(across)))
        .cast("bigint").alias("_opens"),
    )
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        "_cell",
        (F.coalesce(F.sum(F.col("_changes") + F.col("_opens")).over(earlier), F.lit(0))
         + F.col("_opens")).alias("_before"),
    )
    running = by_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        marked.withColumn("_within", F.sum("_change").over(running))
        .join(edges, "_cell")
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_cell", "_change", "_within", "_before")
    )


def first_seen(df: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """Distinct values numbered by first appearance, as a (value, number) table."""
    firsts = df.groupBy(value).agg(F.min(order).alias("_first"))
    return row_numbers(firsts, [], "_first", name).drop("_first")


def first_seen_id(df: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """Dense id of ``value`` by first appearance, joined back to the rows."""
    return lookup(df, first_seen(df, value, order, name), [value])


def pair_number(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """Rows 1 and 2 of a key make pair 1, rows 3 and 4 pair 2, and so on."""
    numbered = row_numbers(df, keys, order, "_position")
    return numbered.withColumn(name, F.ceil(F.col("_position") / 2)).drop("_position")


def complete(df: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """Add a row of NULLs for each (group, level) that does not occur.

    The result holds groups x levels rows by definition, so groups and levels are joined
    without a condition, as tables.
    """
    grid = df.select(*keys).distinct().crossJoin(df.select(level).distinct())
    on = [*keys, level]
    cell = F.struct(*on).alias("_cell")
    rest = [c for c in df.columns if c not in on]
    filled = grid.withColumn("_cell", cell).join(df.select(cell, *rest), "_cell", "left")
    return filled.select(*df.columns)
