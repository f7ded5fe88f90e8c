"""Fixed-effects logistic regression on counted cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from trialspark import schemas as S
from trialspark.operators.contrasts import crossed, nested_contrasts, nested_name, term_names
from trialspark.session import settle

PRIOR_SD = 10.0


# The crossing of all contrasts, and voice nested in target and people or models.
CROSSED = term_names(["voice_n", "data_source_n", "target_response_n"])
NESTED = [
    *(
        nested_name("voice_n", ["target_response", "data_source"], [target, source])
        for source in ("human", "nonhuman")
        for target in (S.OBJECT_TARGET, S.SUBJECT_TARGET)
    ),
    *term_names(["target_response_n", "data_source_n"]),
]


def term_parts(terms: Sequence[str]) -> list[str]:
    return sorted({part for term in terms for part in term.split(":")})


def cell_counts(df: DataFrame, keys: Sequence[str], outcome: str = "correct") -> DataFrame:
    """Rows per combination of keys and outcome; complete rows only."""
    return df.dropna(subset=[*keys, outcome]).groupBy(*keys, outcome).agg(
        F.count(F.lit(1)).alias("weight")
    )


def gram_matrix(columns: Sequence[Column], weight: Column) -> Column:
    """Upper triangle, by rows, of the weighted products of columns: one mergeable aggregate."""
    return F.array(*(F.sum(weight * a * b) for i, a in enumerate(columns) for b in columns[i:]))


def whole_matrix(upper: Sequence[float], size: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    made = np.zeros((size, size))
    made[np.triu_indices(size)] = upper
    return made + np.triu(made, 1).T


def term_value(term: str) -> Column:
    return reduce(lambda a, b: a * b, (F.col(p).cast("double") for p in term.split(":")))


def fit_cells(
    cells: DataFrame, terms: Sequence[str], outcome: str, prior_sd: float
) -> list[tuple[str, float]]:
    columns = [f"_x{i}" for i in range(len(terms))]
    design = cells.select(
        *(term_value(t).alias(c) for t, c in zip(terms, columns)),
        F.col(outcome).cast("double").alias("label"), F.col("weight").cast("double"),
    )
    n = design.agg(F.sum("weight")).first()[0]
    if not n:
        raise ValueError("no complete rows to fit")
    model = LogisticRegression(
        weightCol="weight", elasticNetParam=0.0, standardization=False,
        regParam=1.0 / (prior_sd**2 * n), tol=1e-10, maxIter=500,
    ).fit(VectorAssembler(inputCols=columns, outputCol="features").transform(design))
    return list(zip(["Intercept", *terms],
                    [float(model.intercept), *(float(b) for b in model.coefficients)]))


def fit_map_logit(
    df: DataFrame, terms: Sequence[str], outcome: str = "correct", prior_sd: float = PRIOR_SD
) -> DataFrame:
    """Most probable coefficients under normal(0, ``prior_sd``) priors on the slopes.

    An approximation of the mixed model: it has no random effects, its intercept has no
    prior, and it gives a point, not draws. A term ``a:b`` is the product of its parts. Rows
    are counted per cell first, so the optimiser sees one weighted row per design cell.
    """
    cells = settle(cell_counts(df, term_parts(terms), outcome))
    return df.sparkSession.createDataFrame(
        fit_cells(cells, terms, outcome, prior_sd), "term string, estimate double"
    )


def fit_sources(
    df: DataFrame,
    source_sets: Mapping[str, Sequence[str]] = S.SOURCE_SETS,
    outcome: str = "correct",
    prior_sd: float = PRIOR_SD,
) -> DataFrame:
    """Crossed and nested fits of people against each model, from one count of the rows."""
    contrasts = ["voice_n", "data_source_n", "target_response_n"]
    cells = settle(
        cell_counts(df, ["data_source", "target_response", *contrasts], outcome)
    )
    rows = []
    for name, sources in source_sets.items():
        chosen = cells.where(F.col("data_source").isin(list(sources)))
        two_way = chosen.withColumn(
            "data_source", F.when(F.col("data_source") == S.HUMAN, S.HUMAN).otherwise("nonhuman")
        )
        nested = nested_contrasts(
            two_way, ["voice_n"], ["target_response", "data_source"],
            crossed(S.LEVELS["target_response"], [S.HUMAN, "nonhuman"]),
        )
        for formula, table, terms in (("crossed", chosen, CROSSED), ("nested", nested, NESTED)):
            fitted = fit_cells(table, terms, outcome, prior_sd)
            rows += [(name, formula, term, estimate) for term, estimate in fitted]
    return df.sparkSession.createDataFrame(
        rows, "sources string, formula string, term string, estimate double"
    )


def design_gram(df: DataFrame, terms: Sequence[str], outcome: str = "correct") -> DataFrame:
    """Products of the design's columns, intercept first, summed over complete rows.

    One row per pair of terms, the upper triangle: ``row_term``, ``column_term``, ``total``. All
    sums are one aggregate over counted cells, merged before the shuffle.
    """
    cells = cell_counts(df, term_parts(terms), outcome)
    names = ["Intercept", *terms]
    values = [F.lit(1.0), *map(term_value, terms)]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    total = cells.agg(gram_matrix(values, F.col("weight").cast("double")).alias("gram"))
    return total.select(F.inline(F.array(*(
        F.struct(
            F.lit(names[i]).alias("row_term"), F.lit(names[j]).alias("column_term"),
            F.coalesce(F.col("gram")[n], F.lit(0.0)).alias("total"),
        )
        for n, (i, j) in enumerate(pairs)
    ))))


def fit_with_errors(
    df: DataFrame, terms: Sequence[str], outcome: str = "correct", prior_sd: float = PRIOR_SD,
    level: float = 0.95,
) -> DataFrame:
    """``fit_map_logit`` with ``std_error`` and the ends ``low`` and ``high`` of normal intervals.

    The errors come from the inverse of the weighted products of the design at the estimates, with
    the slopes' prior added: one aggregate over the cells, and a matrix as wide as the formula.
    """
    cells = settle(cell_counts(df, term_parts(terms), outcome))
    fitted = fit_cells(cells, terms, outcome, prior_sd)
    estimates = [b for _, b in fitted]
    values = [F.lit(1.0), *map(term_value, terms)]
    z = reduce(lambda a, b: a + b, (v * b for v, b in zip(values, estimates)))
    chance = 1 / (1 + F.exp(-z))
    weight = F.col("weight") * chance * (1 - chance)
    upper = cells.agg(gram_matrix(values, weight).alias("gram")).first().gram
    curve = whole_matrix(upper, len(values)) + np.diag([0.0, *[prior_sd**-2.0] * len(terms)])
    errors = np.sqrt(np.diag(np.linalg.inv(curve)))
    far = NormalDist().inv_cdf((1 + level) / 2)
    return df.sparkSession.createDataFrame(
        [(t, b, float(e), b - far * float(e), b + far * float(e)) for (t, b), e in zip(fitted, errors)],
        "term string, estimate double, std_error double, low double, high double",
    )
