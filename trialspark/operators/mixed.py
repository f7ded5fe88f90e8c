"""Logistic regression with crossed random effects.

Coefficients and random effects are found by penalised reweighted least squares. Each step solves
its linear system by conjugate gradients without ever forming the matrix: the design rows meet the
current direction of their groups, and what the matrix makes of it comes back as one aggregate per
group. Vectors of random effects are tables with one row per group and never leave the cluster;
the driver holds the coefficients and the covariance matrices, whose sizes are set by the formula.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trialspark.operators.fit import term_parts, term_value, whole_matrix
from trialspark.operators.joins import BROADCAST_BYTES
from trialspark.session import shared_folder

# The helpers below travel with the tasks, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INTERCEPT = "1"


@dataclass(frozen=True)
class Effects:
    """Random effects ``terms`` (``"1"`` is the intercept) of the groups that ``keys`` make."""

    keys: tuple[str, ...]
    terms: tuple[str, ...] = (INTERCEPT,)

    @property
    def name(self) -> str:
        return ":".join(self.keys)


@dataclass
class MixedFit:
    """``coefficients``: ``term``, ``estimate``, ``std_error``. ``covariances``: a matrix per group.

    ``effects``: a table per group with its keys and ``value``, one number per term. ``steps``
    counts the conjugate-gradient steps, ``change`` is the last change of a coefficient.
    """

    coefficients: DataFrame
    covariances: dict[str, np.ndarray]
    effects: dict[str, DataFrame]
    steps: int = 0
    change: float = float("nan")


def _kept(df: DataFrame) -> DataFrame:
    """A written table in the shared folder, read back.

    A checkpoint would keep the estimated sizes of its plan, and those of joins multiply: over many
    steps they become numbers that take longer to multiply than the step itself.
    """
    path = f"{shared_folder(df.sparkSession)}/mixed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _design(terms: Sequence[str], width: int) -> Column:
    values = [F.lit(1.0) if t == INTERCEPT else term_value(t) for t in terms]
    return F.array(*values, *[F.lit(0.0)] * (width - len(terms)))


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch[name].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values, float).reshape(len(values), -1)
    offsets = np.arange(len(values) + 1, dtype="i4") * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def _over(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Arrow batches through ``work``, which gives the columns of ``schema``."""
    names = [f.name for f in T._parse_datatype_string(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                yield pa.RecordBatch.from_arrays([out[n] for n in names], names)

    return df.mapInArrow(run, schema)


# What a task adds up over a batch, and the totals: ``g`` is the group (-1: the coefficients).
PARTIAL = "g int, key string, sums array<double>"
STATE = "g int, key string, u array<double>, block array<double>, s array<double>, r array<double>, d array<double>"


@dataclass(frozen=True)
class _Shape:
    """Numbers of coefficients, of effects per level, and of groups: what tasks need to know."""

    p: int
    width: int
    count: int

    def predicted(self, batch: pa.RecordBatch, fixed: np.ndarray) -> np.ndarray:
        """Per row and system: the design times the coefficients' and the groups' vectors."""
        m = fixed.shape[1]
        value = np.einsum("np,pm->nm", _matrix(batch, "x", self.p), fixed)
        for g in range(self.count):
            z = _matrix(batch, f"z{g}", self.width)
            v = _matrix(batch, f"v{g}", m * self.width).reshape(-1, m, self.width)
            value += np.einsum("ni,nmi->nm", z, v)
        return value

    def per_group(self, batch: pa.RecordBatch, measure: Callable[[np.ndarray], np.ndarray]) -> dict:
        """``measure`` of the designs, added up per level of each group, and over all rows."""
        keys, sums, which = [], [], []
        for g in range(-1, self.count):
            made = measure(_matrix(batch, "x", self.p) if g < 0 else _matrix(batch, f"z{g}", self.width))
            if g < 0:
                names, total = [""], made.sum(axis=0)[None]
            else:
                names, at = np.unique(batch[f"key{g}"].to_numpy(zero_copy_only=False), return_inverse=True)
                total = np.zeros((len(names), made.shape[1]))
                np.add.at(total, at, made)
            keys += list(names)
            which += [g] * len(names)
            sums.append(_lists(total))
        return {"g": pa.array(which, pa.int32()), "key": pa.array(keys, pa.string()), "sums": pa.concat_arrays(sums)}


class _Problem:
    """Design rows and the effects of all groups, a row of ``state`` per group level.

    Designs are filled up to one ``width``, so that all groups share tables and jobs.
    """

    def __init__(self, rows: DataFrame, p: int, groups: Sequence[Effects], prior: float):
        self.rows, self.p, self.groups, self.prior = rows, p, list(groups), prior
        self.width = max(len(g.terms) for g in groups)
        self.shape = _Shape(p, self.width, len(groups))
        self.steps = 0
        levels = None
        for g in range(len(groups)):
            own = rows.select(F.lit(g).alias("g"), F.col(f"key{g}").alias("key")).distinct()
            levels = own if levels is None else levels.union(own)
        self.effects = _kept(levels.withColumn("u", F.array(*[F.lit(0.0)] * self.width)))
        counted = self.effects.groupBy("g").agg(
            F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("bytes")
        ).collect()
        self.levels = {r.g: r.n for r in counted}
        self.key_bytes = sum(r.bytes for r in counted)

    def sent(self, table: DataFrame, arrays: int) -> DataFrame:
        """The table, sent to the rows while its values are small enough; else it is shuffled."""
        size = self.key_bytes + sum(self.levels.values()) * 8 * arrays
        return F.broadcast(table) if size <= BROADCAST_BYTES else table

    def meeting(self, rows: DataFrame, state: DataFrame, column: str, m: int) -> DataFrame:
        """The rows with each group's vector ``v0``, ``v1``, ..."""
        for g in range(len(self.groups)):
            own = state.where(F.col("g") == g).select(F.col("key").alias(f"key{g}"), F.col(column).alias(f"v{g}"))
            rows = rows.join(self.sent(own, m * self.width), f"key{g}")
        return rows

    def totals(self, partial: DataFrame, width: int) -> DataFrame:
        total = F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width)))
        return partial.groupBy("g", "key").agg(total.alias("sums"))

    def newton(self, beta: np.ndarray, inverse: Sequence[np.ndarray]) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray]:
        """At the present estimates: weighted rows, the state with right sides ``r`` and inverted
        blocks, and the coefficients' right side and matrix."""
        p, w, count, shape, prior = self.p, self.width, len(self.groups), self.shape, self.prior
        kept = ["x", *(f"{c}{g}" for g in range(count) for c in ("key", "z"))]

        def weigh(batch: pa.RecordBatch) -> dict:
            chance = 1 / (1 + np.exp(-np.clip(shape.predicted(batch, beta[:, None])[:, 0], -700, 700)))
            n, k = batch["n"].to_numpy(), batch["k"].to_numpy()
            return {c: batch[c] for c in kept} | {
                "weight": pa.array(n * chance * (1 - chance)), "rest": pa.array(k - n * chance)
            }

        kinds = ", ".join(f"{c} {'string' if c.startswith('key') else 'array<double>'}" for c in kept)
        met = self.meeting(self.rows, self.effects, "u", 1)
        weighted = _kept(_over(met.select(*met.columns), weigh, f"{kinds}, weight double, rest double"))

        def add(batch: pa.RecordBatch) -> dict:
            weight, rest = batch["weight"].to_numpy()[:, None], batch["rest"].to_numpy()[:, None]

            def measure(z: np.ndarray) -> np.ndarray:
                a, b = np.triu_indices(z.shape[1])
                return np.hstack([rest * z, weight * z[:, a] * z[:, b]])

            return shape.per_group(batch, measure)

        most = max(p + p * (p + 1) // 2, w + w * (w + 1) // 2)
        totals = _kept(self.totals(_over(weighted, add, PARTIAL), most))
        own = totals.where("g < 0").first().sums
        fixed_rhs = np.array(own[:p]) - prior * beta
        fixed_block = whole_matrix(own[p : p + p * (p + 1) // 2], p) + prior * np.eye(p)

        def turn(batch: pa.RecordBatch) -> dict:
            g, u = batch["g"].to_numpy(), _matrix(batch, "u", w)
            sums = _matrix(batch, "sums", most)
            a, b = np.triu_indices(w)
            whole = np.zeros((len(u), w, w))
            whole[:, a, b] = whole[:, b, a] = sums[:, w : w + len(a)]
            penalty = np.stack(inverse)[g]
            block = np.linalg.inv(whole + penalty)
            r = sums[:, :w] - np.einsum("nij,nj->ni", penalty, u)
            d = np.einsum("nij,nj->ni", block, r)
            return {
                "g": batch["g"], "key": batch["key"], "u": batch["u"], "block": _lists(block),
                "s": _lists(np.zeros_like(r)), "r": _lists(r), "d": _lists(d),
            }

        joined = self.effects.join(self.sent(totals.where("g >= 0"), most), ["g", "key"])
        return weighted, _kept(_over(joined, turn, STATE)), fixed_rhs, fixed_block

    def solve(
        self, state: DataFrame, weighted: DataFrame, inverse: Sequence[np.ndarray], rhs: np.ndarray,
        fixed_block: np.ndarray, tolerance: float, most: int,
    ) -> tuple[DataFrame, np.ndarray]:
        """Solutions of the penalised system for m right sides, by conjugate gradients.

        The blocks of levels and of the coefficients are the preconditioner. Gives the state with
        ``s``, and the coefficients, column by column.
        """
        w, (p, m), shape = self.width, rhs.shape, self.shape
        ready = np.linalg.inv(fixed_block)
        x, r = np.zeros((p, m)), rhs.copy()
        d = ready @ r
        rz = _products(state, w, m, {"rz": ("r", "d")})["rz"] + (r * d).sum(axis=0)
        start = np.where(rz > 0, rz, 1.0)
        for _ in range(most):
            if not (rz > tolerance**2 * start).any():
                break
            fixed = d.copy()

            def push(batch: pa.RecordBatch) -> dict:
                value = shape.predicted(batch, fixed) * batch["weight"].to_numpy()[:, None]
                return shape.per_group(batch, lambda z: (value[:, :, None] * z[:, None, :]).reshape(len(z), -1))

            wide = m * max(p, w)
            met = self.meeting(weighted, state, "d", m)
            made = _kept(self.totals(_over(met, push, PARTIAL), wide))
            h = np.reshape(made.where("g < 0").first().sums[: m * p], (m, p)).T + self.prior * d

            def add(batch: pa.RecordBatch) -> dict:
                g, own = batch["g"].to_numpy(), _matrix(batch, "d", m * w).reshape(-1, m, w)
                block = _matrix(batch, "block", w * w).reshape(-1, w, w)
                new = _matrix(batch, "sums", wide)[:, : m * w].reshape(-1, m, w)
                new = new + np.einsum("nij,nmj->nmi", np.stack(inverse)[g], own)
                return {c: batch[c] for c in ("g", "key", "u", "block", "s", "r", "d")} | {
                    "h": _lists(new), "hz": _lists(np.einsum("nij,nmj->nmi", block, new))
                }

            joined = state.join(self.sent(made.where("g >= 0"), wide), ["g", "key"])
            joined = _kept(_over(joined, add, f"{STATE}, h array<double>, hz array<double>"))
            seen = _products(joined, w, m, {"dh": ("d", "h"), "rh": ("r", "hz"), "hh": ("h", "hz")})
            turned = ready @ h
            dh = seen["dh"] + (d * h).sum(axis=0)
            alpha = np.where(dh > 0, rz / np.where(dh > 0, dh, 1.0), 0.0)
            # The residual's size after the step, from products of the same pass.
            new = rz - 2 * alpha * (seen["rh"] + (r * turned).sum(axis=0))
            new = np.maximum(new + alpha**2 * (seen["hh"] + (h * turned).sum(axis=0)), 0.0)
            beta = np.where(rz > 0, new / np.where(rz > 0, rz, 1.0), 0.0)
            x, r = x + alpha * d, r - alpha * h
            d, rz = ready @ r + beta * d, new
            self.steps += 1
            state = self._stepped(joined, alpha, beta)
        return state, x

    def _stepped(self, joined: DataFrame, alpha: np.ndarray, beta: np.ndarray) -> DataFrame:
        w, m = self.width, len(alpha)

        def move(batch: pa.RecordBatch) -> dict:
            s, r, d, h = (_matrix(batch, c, m * w).reshape(-1, m, w) for c in "srdh")
            block = _matrix(batch, "block", w * w).reshape(-1, w, w)
            r = r - alpha[:, None] * h
            return {c: batch[c] for c in ("g", "key", "u", "block")} | {
                "s": _lists(s + alpha[:, None] * d), "r": _lists(r),
                "d": _lists(np.einsum("nij,nmj->nmi", block, r) + beta[:, None] * d),
            }

        return _over(joined, move, STATE)

    def move(self, state: DataFrame) -> tuple[list[np.ndarray], float]:
        """Adds the step to the effects; means of ``uu' + V`` per group, and the largest change."""
        w = self.width

        def add(batch: pa.RecordBatch) -> dict:
            u, s = _matrix(batch, "u", w), _matrix(batch, "s", w)
            u = u + s
            spread = u[:, :, None] * u[:, None, :] + _matrix(batch, "block", w * w).reshape(-1, w, w)
            return {
                "g": batch["g"], "key": batch["key"], "u": _lists(u), "spread": _lists(spread),
                "most": pa.array(np.abs(s).max(axis=1)),
            }

        moved = _kept(_over(state, add, "g int, key string, u array<double>, spread array<double>, most double"))
        rows = moved.groupBy("g").agg(
            F.array(*(F.avg(F.col("spread")[i]) for i in range(w * w))).alias("mean"), F.max("most").alias("most")
        ).collect()
        self.effects = moved.select("g", "key", "u")
        means = {r.g: np.reshape(r["mean"], (w, w)) for r in rows}
        return [means[g] for g in range(len(self.groups))], max(r.most for r in rows)


def _products(state: DataFrame, w: int, m: int, products: dict[str, tuple[str, str]]) -> dict[str, np.ndarray]:
    """Inner products of columns over all levels, by system."""
    row = state.agg(*(
        F.array(*(
            F.sum(sum((F.col(a)[i] * F.col(b)[i] for i in range(j * w + 1, j * w + w)), F.col(a)[j * w] * F.col(b)[j * w]))
            for j in range(m)
        )).alias(name)
        for name, (a, b) in products.items()
    )).first()
    return {name: np.array(row[name], float) for name in products}


def _filled(sigma: np.ndarray, k: int, width: int) -> np.ndarray:
    """A covariance with ones for the filling, which keeps it at zero."""
    whole = np.eye(width)
    whole[:k, :k] = sigma[:k, :k]
    return whole


def fit_mixed_logit(
    df: DataFrame,
    terms: Sequence[str],
    groups: Sequence[Effects],
    outcome: str = "correct",
    prior_sd: float = 10.0,
    covariances: Sequence[np.ndarray] | None = None,
    rounds: int = 8,
    tolerance: float = 1e-2,
    most_steps: int = 40,
) -> MixedFit:
    """Most probable coefficients and random effects, their covariances and standard errors.

    Coefficients (the intercept too) have normal(0, ``prior_sd``) priors; the effects of each group
    are normal with a covariance of their own. With ``covariances`` given, by group, they are held.
    Otherwise they start at the identity and after each of ``rounds`` steps become the mean of
    ``uu' + V`` over the levels, u a level's effects and V their variance by Laplace's
    approximation within the level. Standard errors are those of the coefficients at these
    covariances, random effects taken into account. A step's system is solved to a residual of
    ``tolerance`` of its right side; what is left is taken up by the next step.

    Rows with a missing key, contrast or outcome are left out; without any complete row it is an
    error. Rows are counted per level, design cell and outcome first, and sums over a level are
    taken per batch before the shuffle, so levels may be of any number and size. Every step writes
    its tables below the shared folder, where they stay.
    """
    names = [INTERCEPT, *terms]
    keys = sorted({k for g in groups for k in g.keys})
    used = {*names, *(t for g in groups for t in g.terms)} - {INTERCEPT}
    wanted = [*keys, *(c for c in term_parts(sorted(used)) if c not in keys)]
    counted = df.dropna(subset=[*wanted, outcome]).groupBy(*wanted).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(outcome).cast("double")).alias("k")
    )
    p, width = len(names), max(len(g.terms) for g in groups)
    rows = _kept(counted.select(
        "n", "k", _design(names, p).alias("x"),
        *(F.to_json(F.struct(*g.keys)).alias(f"key{i}") for i, g in enumerate(groups)),
        *(_design(g.terms, width).alias(f"z{i}") for i, g in enumerate(groups)),
    ))
    if rows.isEmpty():
        raise ValueError("no complete rows to fit")
    problem = _Problem(rows, p, groups, prior_sd**-2.0)
    held = covariances is not None
    sizes = [len(g.terms) for g in groups]
    sigma = [_filled(np.array(c, float), k, width) for c, k in zip(covariances or [np.eye(width)] * len(sizes), sizes)]
    beta, change = np.zeros(p), float("inf")
    for _ in range(rounds):
        inverse = [np.linalg.inv(c) for c in sigma]
        weighted, state, rhs, block = problem.newton(beta, inverse)
        state, step = problem.solve(state, weighted, inverse, rhs[:, None], block, tolerance, most_steps)
        beta, change = beta + step[:, 0], float(np.abs(step).max())
        spread, largest = problem.move(state)
        if not held:
            sigma = [_filled(c, k, width) for c, k in zip(spread, sizes)]
        elif max(change, largest) < 1e-7:
            break
    inverse = [np.linalg.inv(c) for c in sigma]
    weighted, state, _, block = problem.newton(beta, inverse)
    zeros = F.array(*[F.lit(0.0)] * (p * width))
    state = state.select("g", "key", "u", "block", *(zeros.alias(c) for c in "srd"))
    _, variance = problem.solve(state, weighted, inverse, np.eye(p), block, tolerance / 10, most_steps)
    made = df.sparkSession.createDataFrame(
        [(t, float(b), float(v) ** 0.5) for t, b, v in zip(["Intercept", *terms], beta, np.diag(variance))],
        "term string, estimate double, std_error double",
    )
    effects = {}
    for i, g in enumerate(groups):
        kinds = T.StructType([T.StructField(k, df.schema[k].dataType) for k in g.keys])
        effects[g.name] = problem.effects.where(F.col("g") == i).select(
            F.from_json("key", kinds).alias("own"), F.slice("u", 1, sizes[i]).alias("value")
        ).select("own.*", "value")
    found = {g.name: c[:k, :k] for g, c, k in zip(groups, sigma, sizes)}
    return MixedFit(made, found, effects, problem.steps, change)
