"""Exact top-k by block-at-a-time pruning.

A vector is a document whose terms are its components, one term for each sign. Documents lie in
small blocks; a block keeps the largest weight of every term, and the sum of a query's products
with them bounds all scores in the block. Each query takes the blocks in the order of their
bounds, scores them through the block's own vectors and stops where the bound falls below its
k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark.llm.ann import blocked, matrix, one_each, per_length, usable
from trialspark.llm.common import settle, ship

CANDIDATES = 4096  # candidates in one task's range of blocks
QUERIES = 256  # queries in one task
BLOCK = 32  # documents in a block
SEEDS = 1024  # candidates whose scores give every query its first bound


class Blocks:
    """A range of documents in blocks, with term maxima and a forward index per block.

    Documents are put in the order of their strongest terms, so that a block holds like ones.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        strong = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :2]
        signed = 2 * strong + (np.take_along_axis(x, strong, 1) < 0)
        order = np.lexsort((ids, signed[:, 1], signed[:, 0]))
        count = -(-len(x) // BLOCK)
        filled = np.concatenate([order, np.full(count * BLOCK - len(x), -1)])
        self.ids = np.where(filled < 0, -1, ids[filled]).reshape(count, BLOCK)
        self.real = (filled >= 0).reshape(count, BLOCK)
        self.forward = np.where(filled[:, None] < 0, 0, x[filled]).reshape(count, BLOCK, -1)
        # A filler document of zeros only loosens a bound.
        self.most = np.maximum(self.forward.max(axis=1), 0)
        self.least = np.maximum((-self.forward).max(axis=1), 0)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Summed term maxima of every query (rows) for every block."""
        return np.maximum(q, 0) @ self.most.T + np.maximum(-q, 0) @ self.least.T

    def search(
        self, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and ids of each query's k best, worst first, and the blocks scored.

        ``floor`` is a score that the k-th best is known to reach. Places not filled have id -1.
        Equal bounds and scores are looked at, since ties go to smaller ids. All numbers are
        whole and small enough for doubles to hold them exactly.
        """
        bounds = self.bounds(q)
        order = np.argsort(-bounds, axis=1, kind="stable")
        scores = np.full((len(q), k), -np.inf)
        ids = np.full((len(q), k), -1, "i8")
        looked = 0
        for turn in range(bounds.shape[1]):
            at = order[:, turn]
            kth = np.maximum(scores[:, 0], floor)
            live = np.flatnonzero(bounds[np.arange(len(q)), at] >= kth)
            if not len(live):
                break
            looked += len(live)
            own = at[live]
            found = np.einsum("qbd,qd->qb", self.forward[own], q[live])
            takes = self.real[own] & (self.ids[own] != q_ids[live, None])
            found = np.where(takes, found, -np.inf)
            every = np.concatenate([scores[live], found], axis=1)
            names = np.concatenate([ids[live], np.where(takes, self.ids[own], -1)], axis=1)
            best = np.lexsort((-names, every), axis=1)[:, -k:]
            scores[live] = np.take_along_axis(every, best, 1)
            ids[live] = np.take_along_axis(names, best, 1)
        return scores, ids, looked


def top(
    vectors: DataFrame, asked: Column, k: int = 5, scale: int = 256,
    vector: str = "embedding", key: str = "vec_id",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's k highest scores.

    Components become floor(scale * x), and a score is the integer inner product. ``asked`` says
    which rows are queries; candidates are all rows but the query's own.

    Vectors are searched among those of their own length. Those that are missing, empty, or hold
    a missing or non-finite number take no part, nor do rows without a key; a vector of zeros
    does. Repeated rows count once, of several vectors under one key the smallest of the longest
    counts, ties go to the smaller key, other columns are left out, and an empty table gives an
    empty one.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = F.transform(
        F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double")
    )
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector), zero=True)).select(
        F.col(key).cast("long").alias("id"), whole.alias("vector"),
        F.coalesce(asked, F.lit(False)).alias("asks"),
    )
    rows = settle(one_each(rows.where(F.size("vector") > 0)))
    counts = [tuple(r) for r in rows.groupBy("dim").agg(F.count("*"), F.count_if("asks")).orderBy("dim").collect()]
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    # The k-th score among any rows bounds the k-th among all; this sample is bounded.
    seeds = rows.select("id", "vector", "dim").orderBy(F.xxhash64("id"), "id").limit(SEEDS).toArrow()
    seed_dims = seeds["dim"].to_numpy()
    by_dim = {}
    for dim in np.unique(seed_dims):
        own = seeds.filter(pa.array(seed_dims == dim))
        by_dim[int(dim)] = own["id"].to_numpy(), matrix(own["vector"], dim)
    shared = spark.sparkContext.broadcast(by_dim)

    def seeded(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, QUERIES):
                part = batch.slice(first, QUERIES)
                dims, names = part["dim"].to_numpy(), part["id"].to_numpy()
                kth = np.full(len(dims), -np.inf)
                for dim in np.unique(dims):
                    ids, x = shared.value.get(int(dim), ((), None))
                    if len(ids) < k:
                        continue
                    at = np.flatnonzero(dims == dim)
                    scores = matrix(part["vector"].take(pa.array(at)), dim) @ x.T
                    scores[names[at][:, None] == ids[None, :]] = -np.inf
                    kth[at] = np.sort(scores, axis=1)[:, -k]
                yield pa.RecordBatch.from_arrays(
                    [part["dim"], part["id"], part["vector"], pa.array(kth)], ["dim", "id", "vector", "floor"]
                )

    asks = rows.where("asks").select("dim", "id", "vector").mapInArrow(
        seeded, "dim int, id long, vector array<double>, floor double"
    )
    both = rows.select("dim", "id", "vector", F.lit(None).cast("double").alias("floor"), F.lit(1).alias("side")).union(
        asks.select("dim", "id", "vector", "floor", F.lit(0).alias("side"))
    ).select(
        "dim", "id", "side",
        # The bound travels as one more number, so that blocks can be dealt as in other searches.
        F.when(F.col("side") == 0, F.concat("vector", F.array("floor"))).otherwise(F.col("vector")).alias("vector"),
        per_length(counts, CANDIDATES, QUERIES).alias("parts"),
    ).select("*", "parts.*")

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        asks, has = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        out = [np.zeros(0, "i8")] * 3
        if len(asks) and len(has):
            dim = len(has["vector"][0])
            q = matrix(asks["vector"], dim + 1)
            blocks = Blocks(matrix(has["vector"], dim), has["id"].to_numpy())
            q_ids = asks["id"].to_numpy()
            scores, ids, _ = blocks.search(q[:, :dim], q_ids, q[:, dim], k)
            real = scores > -np.inf
            out = [np.repeat(q_ids, k).reshape(ids.shape)[real], ids[real], scores[real].astype("i8")]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out))))

    found = blocked(both, ["dim"]).groupBy("dim", "i", "j").applyInArrow(
        compare, "query_id long, vec_id long, score long"
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
