"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are turned by fast pseudo-rotations, random signs and Hadamard transforms in turn, and
belong to the cell of the nearest signed axis. A query looks into its best cells of every table.
Whatever meets a query in a cell is scored exactly there, so the result needs no second look at
the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark.llm.common import settle, ship

CANDIDATES = 4096  # candidates in one block
QUERIES = 1024  # queries in one block
RATIO = 1.5  # norms of one band of vectors differ by at most this factor
TURNED = 1 << 20  # numbers of one turn of a batch, over all tables
CELLS = 1 << 18  # cells whose sizes are broadcast


@dataclass(frozen=True)
class Tables:
    """Hash tables for ``count`` vectors of ``dim`` numbers and norm at most ``longest``.

    The inner product is reduced to an angle by one more number that fills every vector up to
    the longest norm. A cell is the nearest of ``first`` turned axes, in either direction; where
    all axes are in use and cells would still hold more than about ``fill`` vectors, it is the
    pair with the nearest of ``second`` axes of another rotation. A query looks into
    ``probes`` cells of a table, and into more for long vectors and many cells, growing with the
    power 2/3 of the cells, so the share of the vectors that it meets falls as they become
    more. Where it looks into every cell, one table is enough.
    """

    dim: int
    longest: float
    count: int
    fill: int = 200
    tables: int = 6
    probes: int = 16
    seed: int = 13

    @property
    def width(self) -> int:
        return 1 << max(1, self.dim.bit_length())

    @property
    def first(self) -> int:
        return min(self.width, max(1, self.count // (2 * self.fill)))

    @property
    def second(self) -> int:
        """Axes of the second rotation; 0 if there is none."""
        return min(self.width, round(self.count / (4 * self.fill * self.width)))

    @property
    def looked(self) -> int:
        """Cells of a table that a query looks into."""
        axes = self.first * max(1, 2 * self.second)
        # The second axis is one of few, so its nearest says less.
        least = self.probes * (1.25 if self.second else 1.0)
        wanted = math.ceil(least * (axes / self.width) ** (2 / 3) * self.width / 128)
        return min(2 * axes, max(self.probes, wanted))

    @property
    def used(self) -> int:
        axes = self.first * max(1, 2 * self.second)
        return 1 if self.looked == 2 * axes else self.tables

    def turned(self, x: np.ndarray, level: int) -> np.ndarray:
        """Turned vectors by table, vector and axis; x has ``width`` columns."""
        rng = np.random.default_rng([self.seed, level])
        signs = rng.choice([-1.0, 1.0], (self.tables, 3, self.width))[: self.used]
        out = np.repeat(x[None], self.used, axis=0)
        for turn in range(3):
            out = hadamard(out * signs[:, turn, None, :])
        return out

    def _wide(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        out[:, : self.dim] = x
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell of every vector (rows) in every table (columns)."""
        wide = self._wide(x / self.longest)
        wide[:, self.dim] = np.sqrt(np.maximum(0, 1 - (wide**2).sum(axis=1)))
        cell = nearest_axis(self.turned(wide, 0)[:, :, : self.first])
        if self.second:
            cell = cell * 2 * self.second + nearest_axis(self.turned(wide, 1)[:, :, : self.second])
        return cell.T

    def looks(self, q: np.ndarray) -> np.ndarray:
        """Cells to look into, by query, table and probe, the best first."""
        wide = self._wide(q / np.linalg.norm(q, axis=1, keepdims=True))
        value, cell = best_axes(self.turned(wide, 0)[:, :, : self.first], self.looked)
        if self.second:
            more, other = best_axes(self.turned(wide, 1)[:, :, : self.second], self.looked)
            value = (value[..., :, None] + more[..., None, :]).reshape(*value.shape[:2], -1)
            cell = (cell[..., :, None] * 2 * self.second + other[..., None, :]).reshape(value.shape)
            order = np.argsort(-value, axis=2, kind="stable")[:, :, : self.looked]
            cell = np.take_along_axis(cell, order, 2)
        return cell.transpose(1, 0, 2)


def nearest_axis(axes: np.ndarray) -> np.ndarray:
    """Number of the nearest signed axis along the last one: twice the axis, and 1 if negative."""
    best = np.abs(axes).argmax(axis=-1)
    return 2 * best + (np.take_along_axis(axes, best[..., None], -1)[..., 0] < 0)


def best_axes(axes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and numbers of the ``most`` nearest signed axes, the best first."""
    both = np.stack([axes, -axes], axis=-1).reshape(*axes.shape[:-1], -1)
    order = np.argsort(-both, axis=-1, kind="stable")[..., :most]
    return np.take_along_axis(both, order, -1), order


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast transform along the last axis."""
    width, step = x.shape[-1], 1
    while step < width:
        pairs = x.reshape(*x.shape[:-1], -1, 2, step)
        x = np.stack(
            [pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2
        ).reshape(x.shape)
        step *= 2
    return x / math.sqrt(width)


def usable(vector: Column, zero: bool = False) -> Column:
    """Not missing, and all numbers known and finite; not all zero, unless ``zero``."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if zero:
        return vector.isNotNull() & finite
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def one_each(rows: DataFrame) -> DataFrame:
    """One row per id, with the smallest of its longest vectors, whose length is ``dim``.

    It asks if any of its rows does.
    """
    least = F.min(F.struct((-F.size("vector")).alias("less"), "vector")).alias("least")
    return rows.groupBy("id").agg(least, F.max("asks").alias("asks")).select(
        "id", F.col("least.vector").alias("vector"), "asks", (-F.col("least.less")).alias("dim")
    )


def per_length(counts: Iterable[tuple[int, int, int]], candidates: int, queries: int) -> Column:
    """``ours`` and ``theirs``, the numbers of parts, by ``dim``; from lengths with their counts."""
    parts = [
        x for dim, count, asks in counts
        for x in (F.lit(dim), F.struct(
            F.lit(max(1, -(-count // candidates))).cast("long").alias("ours"),
            F.lit(max(1, -(-asks // queries))).cast("long").alias("theirs"),
        ))
    ]
    return F.create_map(*parts)[F.col("dim")]


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)


def best_of(
    q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query: query ids, candidate ids, scores.

    A matrix product finds what may be among them; those products are then added up in one
    fixed order, so equal vectors get equal scores, and ties go to the smaller id.
    """
    rough = q @ x.T
    found = ([], [], [])
    for i in range(len(q)):
        row = np.where(x_ids == q_ids[i], -np.inf, rough[i])
        if len(row) > k:
            kth = np.partition(row, len(row) - k)[len(row) - k]
            at = np.flatnonzero(row >= kth - 1e-9 * max(1.0, abs(kth))) if kth > -np.inf else np.arange(len(row))
        else:
            at = np.arange(len(row))
        at = at[row[at] > -np.inf]
        exact = (x[at] * q[i]).sum(axis=1)
        order = np.lexsort((x_ids[at], -exact))[:k]
        found[0].append(np.full(len(order), q_ids[i]))
        found[1].append(x_ids[at][order])
        found[2].append(exact[order])
    return tuple(np.concatenate(f) if f else np.zeros(0) for f in found)


def in_blocks(rows: DataFrame, k: int) -> DataFrame:
    """Best candidates per block of rows ``block..., side, id, vector``; side 0 asks.

    All vectors of a block have one length.
    """
    keys = [c for c in rows.columns if c not in ("side", "id", "vector")]

    def compare(table: pa.Table) -> pa.Table:
        ids, side = table["id"].to_numpy(), table["side"].to_numpy()
        vectors = matrix(table["vector"], len(table["vector"][0]))
        asks, has = side == 0, side == 1
        if asks.any() and has.any():
            q, v, s = best_of(vectors[asks], ids[asks], vectors[has], ids[has], k)
        else:
            q, v, s = (np.zeros(0) for _ in range(3))
        return pa.table({
            "query_id": pa.array(q.astype("i8")), "vec_id": pa.array(v.astype("i8")),
            "score": pa.array(s.astype("f8")),
        })

    return rows.groupBy(*keys).applyInArrow(compare, "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all blocks; a pair found twice counts once."""
    pairs = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def norm_groups(
    bands: Iterable[tuple[int, int, int, float]], fill: int, tables: int, probes: int
) -> dict[int, tuple[dict[int, int], list[Tables]]]:
    """By length, the number of the group of each band and the tables of each group.

    Gets length, band, count and logarithm of the longest norm. Bands are taken from the longest
    on. A band of its own has norms of one size; neighbours so few that a query looks into all
    their cells are one group.
    """
    groups: dict[int, list[list]] = {}
    for dim, band, count, longest in sorted(bands, reverse=True):
        own = groups.setdefault(dim, [])
        if own and own[-1][1] + count <= 4 * fill:
            own[-1][0].append(band)
            own[-1][1] += count
            own[-1][2] = max(own[-1][2], longest)
        else:
            own.append([[band], count, longest])
    return {
        dim: (
            {band: i for i, group in enumerate(own) for band in group[0]},
            [Tables(dim, math.exp(min(top, 709.0)), count, fill, tables, probes) for _, count, top in own],
        )
        for dim, own in groups.items()
    }


def nearest(
    vectors: DataFrame, asked: Column, k: int = 20, tables: int = 6, probes: int = 16,
    fill: int = 200, vector: str = "embedding", key: str = "vec_id",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k nearest found for each query.

    ``asked`` says which rows are queries; candidates are all rows but the query's own, and
    nearest means the largest inner product. Vectors whose norms differ by more than a factor of
    ``RATIO`` have tables of their own, as a filler to a much longer norm would hide their
    direction; a query looks into the tables of every group. Cells hold about ``fill`` vectors;
    recall falls with fewer ``tables`` or ``probes``. A query that finds fewer than k is held
    against all vectors in blocks, so it gets k if there are so many.

    Vectors are searched among those of their own length. Those that are missing, zero, or hold
    a missing or non-finite number take no part, nor do rows without a key. Repeated rows count
    once, of several vectors under one key the smallest of the longest counts, ties go to the
    smaller key, other columns are left out, and an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    ship(spark)
    # A row without a key of its own can neither be named nor set apart from the query.
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(asked, F.lit(False)).alias("asks"),
    )
    most = F.array_max(F.transform("vector", F.abs))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / most) * (x / most))
    norm = F.log(most) + F.log(square) / 2
    rows = settle(
        one_each(rows).withColumn("norm", norm)
        .withColumn("band", F.floor(F.col("norm") / math.log(RATIO) + 0.5).cast("int"))
    )
    # Norms of doubles fall into a few thousand bands at most.
    bands = rows.groupBy("dim", "band").agg(
        F.count("*").alias("count"), F.max("norm").alias("longest"), F.count_if("asks").alias("queries")
    ).collect()
    if not bands:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plans = norm_groups(((r.dim, r.band, r["count"], r.longest) for r in bands), fill, tables, probes)

    def hashed(batches):
        for whole in batches:
            # Turned vectors of all tables stay within some tens of megabytes.
            widest = max((plans[d][1][0].width for d in set(whole["dim"].to_pylist())), default=1)
            most_rows = max(1, TURNED // (tables * widest))
            for start in range(0, whole.num_rows, most_rows):
                yield _hash(whole.slice(start, most_rows), plans)

    placed = rows.select("id", "vector", "dim", "band", "asks").mapInArrow(
        hashed,
        "id long, vector array<double>, dim int, grp int, cells array<int>, "
        "looks array<struct<grp:int,tab:int,cell:int>>",
    )
    has = placed.select("dim", "grp", "id", "vector", F.posexplode("cells").alias("tab", "cell")).select(
        "dim", "grp", "tab", "cell", F.lit(1).alias("side"), "id", "vector"
    )
    asks = placed.where("looks is not null").select(
        "dim", "id", "vector", F.explode("looks").alias("own")
    ).select("dim", "own.*", F.lit(0).alias("side"), "id", "vector")
    asks = asks.select(*has.columns)
    both = has.union(asks)
    # Cells are few beside the vectors: one for some hundreds of them. Both sides of a cell are
    # dealt into parts, so that a cell with very many vectors is many blocks.
    keys = ["dim", "grp", "tab", "cell"]
    sizes = settle(both.groupBy(*keys).agg(
        F.ceil(F.greatest(F.lit(1), F.count_if(F.col("side") == 1)) / CANDIDATES).alias("ours"),
        F.ceil(F.greatest(F.lit(1), F.count_if(F.col("side") == 0)) / QUERIES).alias("theirs"),
    ))
    counts: dict[int, list[int]] = {}
    for r in bands:
        own = counts.setdefault(r.dim, [0, 0])
        own[0] += r["count"]
        own[1] += r.queries
    # Eight long numbers a cell: broadcast only while that is small.
    sizes = F.broadcast(sizes) if sizes.count() <= CELLS else sizes
    return _answer(
        rows, blocked(both.join(sizes, keys), keys), k, [(d, n, q) for d, (n, q) in sorted(counts.items())]
    )


def _hash(
    batch: pa.RecordBatch, plans: dict[int, tuple[dict[int, int], list[Tables]]]
) -> pa.RecordBatch:
    """Group and cells of every vector, and for queries the cells to look into."""
    n = batch.num_rows
    dims, bands = batch["dim"].to_numpy(), batch["band"].to_numpy()
    asks = batch["asks"].to_numpy(zero_copy_only=False)
    groups = np.zeros(n, "i4")
    cells: list[list[int] | None] = [None] * n
    looks: list[list[dict] | None] = [[] if a else None for a in asks]
    for dim in np.unique(dims):
        place, tables = plans[dim]
        at = np.flatnonzero(dims == dim)
        x = matrix(batch["vector"].take(pa.array(at)), dim)
        groups[at] = [place[b] for b in bands[at].tolist()]
        for i, table in enumerate(tables):
            here = groups[at] == i
            if here.any():
                for row, own in zip(at[here], table.cells(x[here])):
                    cells[row] = own.tolist()
            if asks[at].any():
                for row, own in zip(at[asks[at]], table.looks(x[asks[at]])):
                    looks[row] += [
                        {"grp": i, "tab": t, "cell": c} for t, some in enumerate(own.tolist()) for c in some
                    ]
    look = pa.struct([("grp", pa.int32()), ("tab", pa.int32()), ("cell", pa.int32())])
    return pa.RecordBatch.from_arrays(
        [batch["id"], batch["vector"], batch["dim"], pa.array(groups),
         pa.array(cells, pa.list_(pa.int32())), pa.array(looks, pa.list_(look))],
        ["id", "vector", "dim", "grp", "cells", "looks"],
    )


def blocked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every part of the candidates with every part of the queries, of equal keys.

    ``ours`` and ``theirs`` are the numbers of candidate and query parts.
    """
    def side(number: int, own: str, others: str) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)).alias("copy")
        part = F.pmod(F.xxhash64("id"), own).alias("part")
        chosen = rows.where(F.col("side") == number)
        return chosen.select(*keys, "side", "id", "vector", part, copies).select(
            *keys, F.col("part" if number else "copy").alias("i"),
            F.col("copy" if number else "part").alias("j"), "side", "id", "vector",
        )

    return side(1, "ours", "theirs").union(side(0, "theirs", "ours"))


def _answer(
    rows: DataFrame, blocks: DataFrame, k: int, counts: list[tuple[int, int, int]]
) -> DataFrame:
    found = settle(ranked(in_blocks(blocks, k), k))
    asked = rows.where("asks").select("id", "dim")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = settle(asked.join(full, "id", "left_anti"))
    dims = {r.dim for r in short.select("dim").distinct().collect()}
    if not dims:
        return found
    # A length with a short query is searched whole.
    again = rows.join(short.select("id").hint("shuffle_hash"), "id", "left_semi").select(
        "dim", F.lit(0).alias("side"), "id", "vector"
    )
    counts = [c for c in counts if c[0] in dims]
    every = rows.where(F.col("dim").isin(sorted(dims))).select("dim", F.lit(1).alias("side"), "id", "vector").union(again)
    every = every.withColumn("parts", per_length(counts, CANDIDATES, QUERIES)).select("*", "parts.*")
    more = ranked(in_blocks(blocked(every, ["dim"]), k), k)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").union(more)
