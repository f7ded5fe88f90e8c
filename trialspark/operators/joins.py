"""Joins of reduced tables to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from trialspark.functions.nulls import same
from trialspark.session import settle

# Of column values; the hash table that Spark builds of them is a few times larger.
BROADCAST_BYTES = 64 << 20


def value_bytes(table: DataFrame) -> int:
    """Size of all values: text by its length, anything else by the default of its type."""
    sizes = [F.lit(8 * len(table.columns))]
    for field in table.schema:
        if isinstance(field.dataType, T.StringType):
            sizes.append(F.coalesce(F.octet_length(f"`{field.name}`"), F.lit(0)))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(f"`{field.name}`"))), F.lit(0)))
    total = table.agg(F.sum(sum(sizes[1:], sizes[0]).cast("bigint"))).first()[0]
    return total or 0


def lookup(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_bytes: int = BROADCAST_BYTES,
    settled: bool = False,
    small: bool | None = None,
) -> DataFrame:
    """Join ``table`` to every row of ``df`` on NULL-safe keys.

    ``table`` is computed once and measured. Up to ``max_bytes`` of values it is broadcast, so
    the rows of ``df`` stay where they are and a hot key costs nothing. A larger table takes a
    shuffle join, where adaptive execution splits the partitions of hot keys. Pass
    ``settled`` for a table that is checkpointed, or quickly read from one that is, and ``small``
    for one that is measured.
    """
    table = table if settled else settle(table)
    renamed = table.select(
        *(F.col(k).alias(f"_on_{k}") for k in on),
        *(c for c in table.columns if c not in on),
    )
    if value_bytes(table) <= max_bytes if small is None else small:
        renamed = F.broadcast(renamed)
    keys = [F.col(f"_on_{k}") for k in on]
    return df.join(renamed, same([F.col(k) for k in on], keys), how).drop(
        *(f"_on_{k}" for k in on)
    )


def lookup_some(
    df: DataFrame, table: DataFrame, on: Sequence[str], only: Column,
    max_bytes: int = BROADCAST_BYTES, settled: bool = False,
) -> DataFrame:
    """A left ``lookup`` into a table whose keys only the rows with ``only`` can have.

    Beside a table that is too large to broadcast, the other rows get NULL and take no part in
    the shuffle, where they might all share a key. ``df`` is then read once for either kind of rows.
    """
    table = table if settled else settle(table)
    if value_bytes(table) <= max_bytes:
        return lookup(df, table, on, settled=True, small=True)
    only = F.coalesce(only, F.lit(False))
    found = lookup(df.where(only), table, on, settled=True, small=False)
    others = df.where(~only).withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in table.schema if f.name not in on}
    )
    return found.unionByName(others)


def fold(
    df: DataFrame, groups: dict[str, Sequence[str]], max_bytes: int = BROADCAST_BYTES
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Replace columns of few combinations by one number, so that a shuffle moves less.

    ``groups`` has the columns by the name of their number. The tables that come with the rows have
    every combination by its number, for ``unfold``. Columns with more than ``max_bytes`` of
    combinations stay as they are; a sketch finds most of them before any is shuffled.
    """
    marked = df.withColumns({
        name: F.xxhash64(*columns, *(F.col(c).isNull() for c in columns))
        for name, columns in groups.items()
    })
    sizes = marked.agg(*(F.approx_count_distinct(name).alias(name) for name in groups)).first()
    tables = {}
    for name, columns in groups.items():
        if sizes[name] * 8 * (len(columns) + 1) > max_bytes:
            continue
        table = settle(marked.select(name, *columns).distinct())
        counts = table.agg(F.count(F.lit(1)), F.count_distinct(name)).first()
        if counts[0] == counts[1] and value_bytes(table) <= max_bytes:
            tables[name] = table
    gone = [c for name, columns in groups.items() for c in (columns if name in tables else [name])]
    return marked.drop(*gone), tables


def unfold(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The columns that ``fold`` replaced."""
    for name, table in tables.items():
        df = lookup(df, table, [name], settled=True, small=True).drop(name)
    return df


def keep_in(df: DataFrame, table: DataFrame, on: Sequence[str], **kw) -> DataFrame:
    """Rows whose keys occur in ``table``."""
    return lookup(df, table.select(*on).distinct(), on, "left_semi", **kw)


def drop_in(df: DataFrame, table: DataFrame, on: Sequence[str], **kw) -> DataFrame:
    """Rows whose keys do not occur in ``table``; a missing key is kept unless listed."""
    return lookup(df, table.select(*on).distinct(), on, "left_anti", **kw)


def flag_in(df: DataFrame, table: DataFrame, on: Sequence[str], name: str, **kw) -> DataFrame:
    """Boolean column saying whether the keys occur in ``table``."""
    marked = table.select(*on).distinct().withColumn(name, F.lit(True))
    return lookup(df, marked, on, "left", **kw).withColumn(
        name, F.coalesce(F.col(name), F.lit(False))
    )
