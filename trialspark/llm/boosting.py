"""Gradient boosted trees on binned features, with calibrated scores.

Examples stay in parts, wherever they are: all that is learned comes from sums over the parts, of
a size that the model fixes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Slopes and curves are summed as whole numbers of this unit, so that the sums, and the trees, are
# the same in any order and division of up to 2^29 examples.
UNIT = 1 << 24


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Part:
    """Examples with how often each occurs; keeps their raw scores for the trees so far."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray):
        self.x, self.y, self.n = x, y, n
        self.binned = self.score = None
        self.walked = 0

    def raw(self, model: Boosted) -> np.ndarray:
        if self.score is None:
            self.binned = model._bin(self.x)
            self.score = np.full(len(self.y), model.start)
        for tree in model.grown[self.walked :]:
            self.score += model._walk(self.binned, tree)
        self.walked = len(model.grown)
        return self.score


# Adds up an array of numbers over all parts of the examples.
Total = Callable[[Callable[[Part], np.ndarray]], np.ndarray]


def as_part(table: pa.Table | pa.RecordBatch, width: int) -> Part:
    """Examples from columns ``x``, ``y`` and ``n``."""
    x = np.array(table.column("x").to_pylist(), "f4").reshape(-1, width)
    return Part(x, np.array(table.column("y").to_pylist(), float), np.array(table.column("n").to_pylist(), float))


def total_of(examples: DataFrame, width: int, most_local: int) -> Total:
    """Sums over a settled table of different examples.

    Up to ``most_local`` examples are kept here. More stay where they are, and every sum is a job.
    """
    few = examples.limit(most_local + 1).count() <= most_local
    if few:
        part = as_part(examples.select("x", "y", "n").toArrow(), width)
        return lambda work: work(part)

    def total(work: Callable[[Part], np.ndarray]) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                if batch.num_rows:
                    own = work(as_part(batch, width))
                    sums = own if sums is None else sums + own
            if sums is not None:
                yield pa.RecordBatch.from_pydict({"sums": pa.array([sums], pa.list_(pa.float64()))})

        sums = (
            examples.select("x", "y", "n").mapInArrow(add, "sums array<double>")
            .select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
            .orderBy("at").toArrow()
        )
        return sums["value"].to_numpy()

    return total


def quantile_edges(examples: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Exact quantiles of every feature over all examples, each as often as it occurs."""
    shares = F.array(*(F.lit(float(s)) for s in np.linspace(0, 1, bins + 1)[1:-1]))
    found = (
        examples.select("n", F.posexplode("x").alias("feature", "value"))
        .groupBy("feature").agg(F.percentile("value", shares, F.col("n")).alias("edges")).collect()
    )
    edges = {r.feature: np.unique(r.edges) for r in found}
    return [edges.get(i, np.zeros(0)) for i in range(width)]


@dataclass
class Boosted:
    """Binary logistic boosting; every tree is a complete binary tree of ``depth`` levels.

    A tree is two arrays over its inner nodes, feature and cut, and the values of its leaves.
    ``calibrate`` fits a slope and a shift of the raw score on held-out rows.
    """

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 24
    ridge: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def fit(self, total: Total, edges: list[np.ndarray]) -> Boosted:
        """``edges`` are those of the bins, per feature."""
        self.edges = edges
        right, every = total(lambda part: np.array([part.n @ part.y, part.n.sum()]))
        share = np.clip(right / every, 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        for _ in range(self.trees):
            self.grown.append(self._grow(total))
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.searchsorted(e, column, side="right") for e, column in zip(self.edges, x.T)], axis=1
        ) if len(x) else np.zeros((0, len(self.edges)), int)

    def _sums(self, part: Part, features: np.ndarray, cuts: np.ndarray, level: int) -> np.ndarray:
        """Slopes and curves by node of the level, feature and bin."""
        p = sigmoid(part.raw(self))
        weights = [np.rint(v * UNIT) * part.n for v in (p - part.y, p * (1 - p))]
        node = self._descend(part.binned, features, cuts, level) - ((1 << level) - 1)
        cells = (1 << level) * (self.bins + 1)
        sums = [
            np.bincount(node * (self.bins + 1) + part.binned[:, f], w, cells)
            for w in weights for f in range(len(self.edges))
        ]
        return np.concatenate(sums)

    def _grow(self, total: Total):
        inner = (1 << self.depth) - 1
        features, cuts = np.zeros(inner, int), np.full(inner, self.bins)
        for level in range(self.depth):
            width, first = 1 << level, (1 << level) - 1
            sums = total(partial(self._sums, features=features, cuts=cuts, level=level)) / UNIT
            g, h = sums.reshape(2, len(self.edges), width, self.bins + 1)
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = (
                gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge)
                - gt**2 / (ht + self.ridge)
            )[:, :, :-1]
            for i in range(width):
                f, at = np.unravel_index(gain[:, i].argmax(), gain[:, i].shape)
                if gain[f, i, at] > 1e-6:
                    features[first + i], cuts[first + i] = f, at
        # The leaves' sums are those to either side of the last level's cuts.
        values = []
        for i in range(width):
            f, at = features[first + i], cuts[first + i]
            for g, h in ((gl[f, i, at], hl[f, i, at]), (gt[f, i, 0] - gl[f, i, at], ht[f, i, 0] - hl[f, i, at])):
                values.append(-self.rate * g / (h + self.ridge))
        return features, cuts, np.array(values)

    def _descend(self, binned, features, cuts, levels: int) -> np.ndarray:
        node = np.zeros(len(binned), int)
        for _ in range(levels):
            node = 2 * node + 1 + (binned[np.arange(len(node)), features[node]] > cuts[node])
        return node

    def _walk(self, binned, tree):
        features, cuts, values = tree
        return values[self._descend(binned, features, cuts, self.depth) - len(features)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.start + sum((self._walk(binned, t) for t in self.grown), np.zeros(len(x)))

    def calibrate(self, total: Total, steps: int = 30) -> Boosted:
        """Newton steps for the two numbers, with a weak pull towards slope 1 and shift 0."""
        a = np.array([1.0, 0.0])

        def sums(part: Part) -> np.ndarray:
            raw = part.raw(self)
            design = np.stack([raw, np.ones(len(raw))], axis=1)
            p = sigmoid(design @ a)
            bend = (design * (part.n * p * (1 - p))[:, None]).T @ design
            return np.concatenate([design.T @ (part.n * (p - part.y)), bend.ravel()])

        for _ in range(steps):
            found = total(sums)
            step = np.linalg.solve(found[2:].reshape(2, 2) + np.eye(2), found[:2] + (a - [1.0, 0.0]))
            a = a - step
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = map(float, a)
        return self

    def certain(self, raw: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * raw + self.shift)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.certain(self.raw(x))


def threshold(
    p: np.ndarray, y: np.ndarray, precision: float, n: np.ndarray | None = None
) -> float:
    """Lowest score at and above which held-out rows reach the precision; over 1 if none does.

    With ``n`` a score stands for so many rows, ``y`` of them right.
    """
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order]) / np.cumsum(np.ones(len(p)) if n is None else n[order])
    last = np.append(p[order][1:] != p[order][:-1], True)
    good = np.flatnonzero((hits >= precision) & last)
    return float(p[order][good[-1]]) if len(good) else 1.1
