"""Nested contrasts and interaction terms."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations, product
from math import prod

from pyspark.sql import DataFrame, Window, functions as F

from trialspark.functions.nulls import same
from trialspark.operators.joins import lookup
from trialspark.session import settle

# Separators of generated column names.
NESTING = "_i_n_"
LEVEL = "_a_t_"


def factor_initials(factor: str) -> str:
    """First letter of each part: ``target_response`` gives ``tr``."""
    return "".join(part[:1] for part in factor.split("_"))


def clean_name(name: str) -> str:
    """Lower case, with punctuation and blanks as one underscore; dots stay."""
    return re.sub(r"_$", "", re.sub(r"(?:(?!\.)[^\w\s]|_| )+", "_", name).lower())


def nested_name(column: str, factors: Sequence[str], levels: Sequence) -> str:
    """Name of ``column`` within the given levels."""
    parts = [
        f"{factor_initials(f)}{LEVEL}{'NA' if v is None else v}"
        for f, v in zip(factors, levels)
    ]
    return f"{column}{NESTING}{clean_name(NESTING.join(parts))}"


def crossed(*levels: Sequence) -> list[tuple]:
    """All tuples of one level from each list."""
    return list(product(*levels))


def nested_contrasts(
    df: DataFrame,
    columns: Sequence[str],
    factors: Sequence[str],
    levels: Sequence[tuple],
    fill: float = 0.0,
) -> DataFrame:
    """Add each column nested in every combination of levels of the other factors.

    ``levels`` lists tuples of levels in the order of ``factors``, as they become columns. For
    each non-empty set of the factors other than the column itself, each distinct tuple of
    their levels makes one new column: the value inside the tuple, ``fill`` outside. For
    levels that are not known beforehand there is ``nested_long``.
    """
    new = {}
    for column in columns:
        others = [i for i, f in enumerate(factors) if f != column]
        for size in range(1, len(others) + 1):
            for chosen in combinations(others, size):
                names = [factors[i] for i in chosen]
                inside = {}
                for inner in sorted({tuple(row[i] for i in chosen) for row in levels}, key=str):
                    here = same([F.col(f"`{n}`") for n in names], [F.lit(v) for v in inner])
                    name = nested_name(column, names, inner)
                    # levels whose cleaned names coincide share a column
                    inside[name] = inside[name] | here if name in inside else here
                for name, condition in inside.items():
                    new[name] = F.when(condition, F.col(f"`{column}`")).otherwise(F.lit(fill))
    return df.withColumns(new)


def nested_long(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    factors: Sequence[str],
    fill: float = 0.0,
) -> DataFrame:
    """The nested contrasts of each row as rows: ``keys``, ``contrast``, ``levels``, ``value``.

    ``contrast`` is the column within the names of the chosen factors, ``levels`` an array of
    their levels as strings. Each row meets every tuple of levels that occurs, so the tuples
    are a table that is joined and no list in the driver.
    """
    long = None
    for column in columns:
        others = [f for f in factors if f != column]
        for size in range(1, len(others) + 1):
            for chosen in combinations(others, size):
                own = F.array(*(F.col(f"`{f}`").cast("string") for f in chosen))
                rows = df.select(*keys, F.col(f"`{column}`").cast("double").alias("_x"), own.alias("_own"))
                every = rows.select(F.col("_own").alias("levels")).distinct()
                inside = F.col("_own").eqNullSafe(F.col("levels"))
                part = rows.crossJoin(every).select(
                    *keys, F.lit(NESTING.join((column, *chosen))).alias("contrast"), "levels",
                    F.when(inside, F.col("_x")).otherwise(F.lit(fill)).alias("value"),
                )
                long = part if long is None else long.union(part)
    return long


def _nestings(columns: Sequence[str], factors: Sequence[str]) -> list[tuple[str, str, tuple]]:
    """Name, column and factors of every nested contrast."""
    return [
        (NESTING.join((column, *chosen)), column, chosen)
        for column in columns
        for size in range(1, len(factors) + 1)
        for chosen in combinations([f for f in factors if f != column], size)
    ]


def level_dictionary(
    df: DataFrame, columns: Sequence[str], factors: Sequence[str]
) -> DataFrame:
    """``contrast``, ``levels`` and ``slot`` of every nested contrast that occurs.

    Slots count from 0 in the order of contrast and levels, so they depend on the data alone.
    Rows are read once for their distinct tuples of all factors. Tuples are numbered within
    partitions of one sorted table, and a table with a row per partition carries the totals.
    """
    tuples = settle(df.select(*(F.col(f"`{f}`").cast("string").alias(f) for f in factors)).distinct())
    parts = [
        tuples.select(F.lit(name).alias("contrast"), F.array(*(F.col(f"`{f}`") for f in chosen)).alias("levels"))
        .distinct()
        for name, _, chosen in _nestings(columns, factors)
    ]
    if not parts:
        return df.sparkSession.createDataFrame([], "contrast string, levels array<string>, slot bigint")
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    placed = settle(
        every.orderBy("contrast", "levels").withColumn("_id", F.monotonically_increasing_id())
    )
    # An id is the partition's number in the upper bits and the place in it in the lower 33.
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return settle(
        lookup(placed, starts, ["_part"]).select(
            "contrast", "levels",
            (F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("slot"),
        )
    )


def nested_sparse(
    df: DataFrame, columns: Sequence[str], factors: Sequence[str], dictionary: DataFrame,
    name: str = "nested",
) -> DataFrame:
    """The nested contrasts of each row as one sparse vector ``name``.

    The vector is an array of ``slot`` and ``value`` by slot: one entry per contrast, in the slot
    that ``dictionary`` gives to the row's own levels; every other slot is 0. A missing value stays
    missing, and levels that the dictionary lacks have no entry. The size of a row does not
    depend on the number of levels, and each contrast is one join of the dictionary.
    """
    own = {f: f"_own_{i}" for i, f in enumerate(factors)}
    rows = df.withColumns({o: F.col(f"`{f}`").cast("string") for f, o in own.items()})
    entries = []
    for i, (contrast, column, chosen) in enumerate(_nestings(columns, factors)):
        table = dictionary.where(F.col("contrast") == contrast).select(
            *(F.col("levels")[j].alias(own[f]) for j, f in enumerate(chosen)), F.col("slot").alias(f"_slot_{i}")
        )
        rows = lookup(rows, table, [own[f] for f in chosen], settled=True)
        entries.append(F.struct(
            F.col(f"_slot_{i}").alias("slot"), F.col(f"`{column}`").cast("double").alias("value")
        ))
    kind = "array<struct<slot:bigint,value:double>>"
    vector = F.array_sort(F.filter(F.array(*entries).cast(kind), lambda e: e["slot"].isNotNull()))
    return rows.select(*(F.col(f"`{c}`") for c in df.columns if c != name), vector.alias(name))


def term_names(contrasts: Sequence[str]) -> list[str]:
    """Terms of the full crossing, ``a*b*c``: main effects first, then interactions."""
    return [
        ":".join(term)
        for size in range(1, len(contrasts) + 1)
        for term in combinations(contrasts, size)
    ]


def interaction_terms(df: DataFrame, crossing: str) -> DataFrame:
    """Product columns of a crossing such as ``"voice_n * data_source_n"``."""
    contrasts = [part.strip() for part in crossing.split("*")]
    products = {
        term: prod((F.col(part) for part in term.split(":")[1:]), start=F.col(term.split(":")[0]))
        for term in term_names(contrasts)
        if ":" in term
    }
    return df.withColumns(products)
