"""Nearest neighbours and exact top scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, side int, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, 2, "x") for k, v in rows], SCHEMA)


def awkward(rng, n=300, dim=12):
    rows = [(i, rng.normal(size=dim).astype("f4").tolist()) for i in range(n)]
    same = rows[7][1]
    rows += [(i, same) for i in range(n, n + 60)]  # ties
    rows += [(1000, None), (1001, [0.0] * dim), (1020, [float("nan")] + [1.0] * (dim - 1)), (None, same)]
    rows += [(1040, [None] + [1.0] * (dim - 1)), (1060, [1.0] * (dim - 1)), (1080, [float("inf")] * dim), rows[3]]
    return rows


def valid(rows, dim=12, zero=False):
    return {
        k: np.array(v, "f8") for k, v in rows
        if k is not None and v and len(v) == dim and None not in v and np.isfinite(v).all() and (zero or any(v))
    }


def brute(vectors, every, k, score):
    out = []
    for q in sorted(vectors):
        if q % every == 0:
            others = sorted((-score(vectors[q], x), i) for i, x in vectors.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(others[:k])]
    return out


def as_rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("n,k", [(300, 20), (6, 20), (0, 3)])
def test_nearest_with_all_probes_is_exact(spark, n, k):
    rows = awkward(np.random.default_rng(n), n) if n > 7 else [(i, [1.0 + i, 2.0]) for i in range(n)]
    dim = 12 if n > 7 else 2
    found = as_rows(ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=k, probes=64, fill=10))
    expected = brute(valid(rows, dim), 20, k, lambda a, b: float((a * b).sum()))
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    assert np.allclose([r[3] for r in found], [r[3] for r in expected], rtol=1e-12)


def test_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = as_rows(ann.nearest(docs, F.col("vec_id") % 20 == 0, fill=40, tables=6, probes=16))
    vectors = {r.vec_id: np.array(r.embedding, "f8") for r in docs.collect()}
    expected = {r[0::2][:2] for r in brute(vectors, 20, 20, lambda a, b: float(a @ b))}
    assert len({r[0::2][:2] for r in found} & expected) >= 0.9 * len(expected)


@pytest.mark.parametrize("kind", ["even", "lognormal", "one long", "far apart"])
@pytest.mark.parametrize("dim,n", [(64, 20_000), (384, 8_000)])
def test_tables_meet_the_nearest_for_any_norms(kind, dim, n):
    """Production parameters; ``far apart`` has norms over 60 powers of ten."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lognormal":
        x *= rng.lognormal(0, 0.3, (n, 1))
    elif kind == "one long":
        x[0] *= 10
    elif kind == "far apart":
        x *= 10.0 ** rng.integers(-30, 30, (n, 1))
    q = x[1:31]
    nearest = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :20]
    norms = np.log(np.linalg.norm(x, axis=1))
    bands = np.floor(norms / np.log(ann.RATIO) + 0.5).astype(int)
    plans = ann.norm_groups(
        [(dim, int(b), int((bands == b).sum()), norms[bands == b].max()) for b in np.unique(bands)], 200, 6, 16
    )
    place, tables = plans[dim]
    group = np.array([place[b] for b in bands])
    met = np.zeros((len(q), n), bool)
    for i, table in enumerate(tables):
        at = np.flatnonzero(group == i)
        cells, looks = np.concatenate([table.cells(x[part]) for part in np.array_split(at, len(at) // 500 + 1)]), table.looks(q)
        for j in range(len(q)):
            for t in range(table.used):
                met[j, at] |= np.isin(cells[:, t], looks[j, t])
    assert np.take_along_axis(met, nearest, 1).mean() >= 0.9


def test_more_vectors_have_finer_cells_and_a_smaller_share_met():
    looked = []
    for count in (20_000, 200_000, 2_000_000, 20_000_000):
        table = ann.Tables(64, 1.0, count)
        cells = 2 * table.first * max(1, 2 * table.second)
        assert count / cells <= 1.6 * table.fill or table.second == table.width
        looked.append(table.looked / cells)
    assert looked == sorted(looked, reverse=True) and looked[-1] < 0.2 * looked[0]


def test_uneven_norms_end_to_end(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24)) * rng.lognormal(0, 1.0, (3000, 1))
    x[5] *= 1e6
    rows = [(i, v.astype("f4").tolist()) for i, v in enumerate(x)]
    found = as_rows(ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, fill=40))
    expected = brute(valid(rows, 24), 20, 20, lambda a, b: float(a @ b))
    assert len({r[0::2][:2] for r in found} & {r[0::2][:2] for r in expected}) >= 0.9 * len(expected)


def test_few_found_are_filled_up(spark):
    rows = awkward(np.random.default_rng(5))
    found = as_rows(ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=50, tables=1, probes=1, fill=2))
    per = {}
    for r in found:
        per.setdefault(r[0], []).append(r[1])
    assert all(ranks == list(range(1, 51)) for ranks in per.values()) and len(per) == 18


@pytest.mark.parametrize("n", [300, 4, 0])
def test_top_scores(spark, n, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    rows = awkward(np.random.default_rng(n), n) if n > 7 else [(i, [0.5, -0.25]) for i in range(n)]
    whole = {k: np.floor(256 * v).astype("i8") for k, v in valid(rows, 12 if n > 7 else 2, zero=True).items()}
    found = as_rows(topk.top(frame(spark, rows), F.col("vec_id") % 50 == 0))
    assert found == brute(whole, 50, 5, lambda a, b: int(a @ b))


def test_blocks_are_pruned():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 200
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)) * 5)
    blocks = topk.Blocks(x, np.arange(4000))
    scores, ids, looked = blocks.search(x[:50], np.arange(50), np.full(50, -np.inf), 5)
    exact = x[:50] @ x.T
    exact[np.arange(50), np.arange(50)] = -np.inf
    assert (np.sort(exact, axis=1)[:, -5:] == scores).all()
    assert looked < 0.5 * 50 * len(blocks.most)


@pytest.mark.parametrize("score", ["nearest", "top"])
def test_one_longer_row_removes_no_others(spark, score):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).tolist()) for i in range(120)] + [(200, [1.0] * 9)]
    expected = []
    for dim in (5, 8, 9):
        own = valid([(i, np.array(v, "f4").tolist()) for i, v in rows], dim)
        if score == "top":
            own = {i: np.floor(256 * v).astype("i8") for i, v in own.items()}
        expected += brute(own, 20, 5, lambda a, b: (a * b).sum().item())
    if score == "top":
        found = topk.top(frame(spark, rows), F.col("vec_id") % 20 == 0, k=5)
    else:
        found = ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=5, probes=64, fill=10)
    assert len(expected) == 30
    assert [r[:3] for r in as_rows(found)] == [r[:3] for r in sorted(expected)]
