"""Summaries of posterior draws, one row per draw and one column per parameter."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from trialspark.functions.text import PLOT_WORDS, effect_label
from trialspark.operators.quantiles import exact_quantiles
from trialspark.session import settle


def parameters(draws: DataFrame, pattern: str) -> list[str]:
    """Columns whose name matches."""
    return [c for c in draws.columns if re.search(pattern, c)]


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _per_parameter(draws: DataFrame, names: list[str], **measures) -> DataFrame:
    """Aggregate every column at once, then turn the one wide row into one row each."""
    wide = draws.agg(
        *(
            F.struct(
                F.lit(i).alias("position"), F.lit(name).alias("name"),
                *(make(_quoted(name)).alias(m) for m, make in measures.items()),
            ).alias(f"_{i}")
            for i, name in enumerate(names)
        )
    )
    return wide.select(F.inline(F.array(*(f"_{i}" for i in range(len(names))))))


def p_mcmc(draws: DataFrame, pattern: str = "^b_") -> DataFrame:
    """Share of draws above zero of each parameter, and the report's direction and stars."""
    shares = _per_parameter(
        draws, parameters(draws, pattern),
        above=lambda c: F.count_if(c > 0), n=lambda c: F.count(F.lit(1)),
    )
    share = F.col("above") / F.col("n")
    p = F.when(share > 0.5, 1 - share).otherwise(share)
    stars = F.when(p < 0.0001, "***").when(p < 0.001, "**").when(p < 0.05, "*").otherwise("")
    return shares.select(
        "position", "name", share.alias("p_mcmc"), p.alias("p"),
        F.when(share > 0.5, " < 0").otherwise(" > 0").alias("direction"),
        stars.alias("stars"),
    )


def p_mcmc_report(
    draws: DataFrame, model_name: str, pattern: str = "^b_", digits: int = 4
) -> DataFrame:
    """The report as ordered lines: heading, one line per parameter, closing rule."""
    table = p_mcmc(draws, pattern)
    line = F.concat(
        F.printf(F.lit(f"%.0{digits}f"), "p"), F.lit(": "), effect_label(F.col("name")),
        F.col("direction"), F.lit(" "), F.col("stars"),
    )
    rule = F.lit("#" * 81)
    heading = [rule, F.lit(f"{model_name} posteriors"), F.lit("-" * 81)]
    count = len(parameters(draws, pattern))

    def fixed(lines: list[Column], start: int) -> DataFrame:
        rows = F.array(
            *(F.struct(F.lit(start + i).alias("line_no"), x.alias("line"))
              for i, x in enumerate(lines))
        )
        return draws.sparkSession.range(1).select(F.inline(rows))

    body = table.select((F.col("position") + 4).alias("line_no"), line.alias("line"))
    return fixed(heading, 1).unionByName(body).unionByName(fixed([rule], count + 4))


def unpivot_draws(draws: DataFrame, names: list[str]) -> DataFrame:
    columns = [_quoted(n) for n in names]
    return draws.select(*columns).unpivot([], columns, "name", "value")


def posterior_summary(draws: DataFrame, pattern: str = r"^b_(?!Intercept)") -> DataFrame:
    """Mean, 95 % and 99 % intervals and plot label of each slope."""
    names = parameters(draws, pattern)
    means = _per_parameter(draws, names, mean=F.avg).select("name", "mean")
    intervals = exact_quantiles(
        unpivot_draws(draws, names), ["name"], "value",
        {"low_99": 0.005, "low_95": 0.025, "high_95": 0.975, "high_99": 0.995},
    )
    # One row per model parameter on either side.
    return means.join(F.broadcast(intervals), "name").withColumn(
        "label", effect_label(F.col("name"), PLOT_WORDS)
    )


def draw_histogram(
    draws: DataFrame, pattern: str = "^b_|^sd_|^cor_", bins: int = 30
) -> DataFrame:
    """Counts per equal-width bin of each parameter; the largest draw is in the last bin."""
    names = parameters(draws, pattern)
    ranges = _per_parameter(draws, names, lo=F.min, hi=F.max).select("name", "lo", "hi")
    # One row per model parameter, so the ranges are broadcast whatever the draws.
    placed = unpivot_draws(draws, names).join(F.broadcast(ranges), "name")
    width = (F.col("hi") - F.col("lo")) / bins
    bin_no = F.when(width > 0, F.least(
        F.floor((F.col("value") - F.col("lo")) / width) + 1, F.lit(bins)
    )).otherwise(1)
    return placed.groupBy("name", bin_no.cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("lo").alias("lo"), F.min("hi").alias("hi"),
    )


def draw_density(
    draws: DataFrame, pattern: str = r"^b_(?!Intercept)", points: int = 128, reach: float = 3.0,
    outer: float = 0.99, inner: float = 0.95,
) -> DataFrame:
    """Density curves of the parameters, with the parts under the curve that plots shade.

    ``points`` values ``x`` from the least to the largest draw, and ``density``, a Gaussian kernel
    estimate with Silverman's bandwidth ``1.06 sd n^-0.2``. Draws are counted on the grid first, so
    the curve is a convolution of at most ``points`` counts per parameter, whatever the draws.
    ``part`` is ``inner`` or ``outer`` within the equal-tailed intervals, and ``tail`` beyond them.
    Kernels end ``reach`` bandwidths away. A parameter without spread has one point with no density.
    """
    names = parameters(draws, pattern)
    spans = _per_parameter(
        draws, names, lo=F.min, hi=F.max, sd=F.stddev_samp, n=F.count
    ).drop("position")
    long = unpivot_draws(draws, names)
    tails = {
        "low_outer": (1 - outer) / 2, "low_inner": (1 - inner) / 2,
        "high_inner": (1 + inner) / 2, "high_outer": (1 + outer) / 2,
    }
    # All tables below have one row per parameter, or one per parameter and grid point.
    spans = spans.join(F.broadcast(exact_quantiles(long, ["name"], "value", tails)), "name").withColumns({
        "step": (F.col("hi") - F.col("lo")) / (points - 1),
        "width": 1.06 * F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)),
    })
    spans = settle(spans)
    at = F.when(F.col("step") > 0, F.round((F.col("value") - F.col("lo")) / F.col("step"))).otherwise(0)
    counted = long.join(F.broadcast(spans.select("name", "lo", "step")), "name").groupBy(
        "name", at.cast("int").alias("cell")
    ).agg(F.count("value").alias("m"))
    # Each count reaches the grid points within its kernel.
    far = F.least(F.ceil(reach * F.col("width") / F.col("step")), F.lit(points)).cast("int")
    spread = counted.join(F.broadcast(spans), "name").where("step > 0").select(
        "name", "m", "cell", "step", "width", "n",
        F.explode(F.sequence(
            F.greatest(F.col("cell") - far, F.lit(0)), F.least(F.col("cell") + far, F.lit(points - 1))
        )).alias("point"),
    )
    away = (F.col("point") - F.col("cell")) * F.col("step") / F.col("width")
    kernel = F.exp(-away * away / 2) / (F.col("n") * F.col("width") * F.sqrt(F.lit(2 * math.pi)))
    curve = spread.groupBy("name", "point").agg(F.sum(F.col("m") * kernel).alias("density"))
    grid = spans.select("*", F.explode(F.sequence(
        F.lit(0), F.when(F.col("step") > 0, points - 1).otherwise(0)
    )).alias("point"))
    x = F.col("lo") + F.col("point") * F.col("step")
    within = lambda name: F.col("x").between(F.col(f"low_{name}"), F.col(f"high_{name}"))
    return grid.join(curve, ["name", "point"], "left").withColumn("x", x).select(
        "name", "point", "x",
        F.when(F.col("step") > 0, F.coalesce("density", F.lit(0.0))).alias("density"),
        F.when(within("inner"), "inner").when(within("outer"), "outer").otherwise("tail").alias("part"),
    )


def draw_trace(
    draws: DataFrame, chain: str, order: str, pattern: str = "^b_|^sd_|^cor_", pixels: int = 200
) -> DataFrame:
    """What a trace plot of so many ``pixels`` shows of each chain and parameter.

    A pixel column covers an equal stretch of the chain's positions (``order``, integers) and keeps
    its first, last, least and largest draw; a draw that is several of these appears once. The
    shape is exact, and a chain with no more positions than pixels keeps every draw. Draws that are
    NULL are left out; of draws at one position the smallest comes first.
    """
    names = parameters(draws, pattern)
    own = [_quoted(chain).alias("chain"), _quoted(order).cast("long").alias("position")]
    long = draws.select(*own, *(_quoted(n) for n in names)).unpivot(
        ["chain", "position"], [_quoted(n) for n in names], "name", "value"
    ).where("value is not null")
    # One row per chain.
    ends = draws.select(*own).groupBy("chain").agg(F.min("position").alias("from"), F.max("position").alias("to"))
    ends = ends.withColumnRenamed("chain", "of")
    placed = long.join(F.broadcast(ends), F.col("chain").eqNullSafe(F.col("of")))
    length = F.col("to") - F.col("from") + 1
    pixel = F.when(length <= pixels, F.col("position") - F.col("from")).otherwise(
        F.floor((F.col("position") - F.col("from")) * pixels / length)
    ).cast("long")
    in_time, by_value = F.struct("position", "value"), F.struct("value", "position")
    kept = placed.groupBy("chain", "name", pixel.alias("pixel")).agg(
        F.min(in_time).alias("a"), F.max(in_time).alias("b"), F.min(by_value).alias("c"), F.max(by_value).alias("d"),
    )
    draw = lambda c: F.struct(F.col(c)["position"].alias("position"), F.col(c)["value"].alias("value"))
    return kept.select(
        "chain", "name", "pixel", F.inline(F.array_distinct(F.array(*map(draw, "abcd"))))
    )
