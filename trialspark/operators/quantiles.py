"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from trialspark.operators.joins import lookup
from trialspark.session import settle

ACCURACY = 100_000
MARGIN = 4 / ACCURACY


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    strict: bool = False,
) -> DataFrame:
    """Linearly interpolated quantiles (type 7) per group, one column per name in ``probs``.

    ``percentile`` keeps all distinct values of a group in one task. Here a mergeable sketch
    brackets each quantile first; the second pass counts what lies below the bracket and
    shuffles only the values inside it, about one in ten thousand. A bracket that misses
    raises an error instead of returning a wrong value. With ``strict`` a group with a
    missing value gets NULL.
    """
    probs = dict(sorted(probs.items(), key=lambda item: item[1]))
    names = list(probs)
    lows = [max(p - MARGIN, 0.0) for p in probs.values()]
    highs = [min(p + MARGIN, 1.0) for p in probs.values()]
    x = F.col(value).cast("double")
    sketched = settle(
        df.groupBy(*keys).agg(
            F.percentile_approx(x, [*lows, *highs], ACCURACY).alias("_marks"),
            F.count(x).alias("_n"),
            F.count(F.lit(1)).alias("_rows"),
        ).select(
            *keys, "_n", "_rows", F.slice("_marks", 1, len(lows)).alias("_lows"),
            F.slice("_marks", len(lows) + 1, len(highs)).alias("_highs"),
        )
    )
    rows = lookup(
        df.where(F.col(value).isNotNull()).select(*keys, x.alias("_x")), sketched, keys, "inner",
        settled=True,
    )
    # Brackets are sorted, so the number of edges passed orders all values in zones: each
    # bracket's values one by one, everything between two brackets as one count.
    edges = range(len(names))
    entered = sum((F.col("_x") >= F.col("_lows")[i]).cast("int") for i in edges)
    left = sum((F.col("_x") > F.col("_highs")[i]).cast("int") for i in edges)
    zoned = rows.select(
        *keys, "_n", "_x", (entered + left).alias("_zone"), (entered > left).alias("_inside")
    )
    counts = zoned.groupBy(
        *keys, "_n", "_zone", "_inside", F.when(F.col("_inside"), F.col("_x")).alias("_value")
    ).agg(
        F.count(F.lit(1)).alias("_count"), F.min("_x").alias("_min"), F.max("_x").alias("_max")
    )
    upward = Window.partitionBy(*keys).orderBy("_zone", "_value")
    placed = counts.withColumn(
        "_upto", F.sum("_count").over(upward.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_from", F.col("_upto") - F.col("_count"))

    def value_at(index):
        # Between brackets only the values next to one have a known position.
        found = (
            F.when(F.col("_inside"), F.col("_value"))
            .when(index == F.col("_upto") - 1, F.col("_max"))
            .when(index == F.col("_from"), F.col("_min"))
            .otherwise(F.raise_error(F.lit("quantile outside its bracket")).cast("double"))
        )
        return F.max(F.when((index >= F.col("_from")) & (index < F.col("_upto")), found))

    def position(p):
        return (F.col("_n") - 1) * F.lit(float(p))

    ends = placed.groupBy(*keys, "_n").agg(
        *(value_at(F.floor(position(p))).alias(f"_lo{i}") for i, p in enumerate(probs.values())),
        *(value_at(F.ceil(position(p))).alias(f"_hi{i}") for i, p in enumerate(probs.values())),
    )

    def between(i, p):
        lo, hi, at = F.col(f"_lo{i}"), F.col(f"_hi{i}"), position(p)
        return lo + (at - F.floor(at)) * (hi - lo)

    quantiles = ends.select(
        *keys, *(between(i, p).alias(n) for i, (n, p) in enumerate(probs.items()))
    )
    groups = sketched.select(
        F.struct(*keys).alias("_group"), (F.col("_n") == F.col("_rows")).alias("_whole")
    )
    joined = groups.join(quantiles.select(F.struct(*keys).alias("_group"), *names), "_group", "left")
    kept = F.col("_whole") if strict else F.lit(True)
    return joined.select(
        *(F.col("_group")[k].alias(k) for k in keys), *(F.when(kept, F.col(n)).alias(n) for n in names)
    )
