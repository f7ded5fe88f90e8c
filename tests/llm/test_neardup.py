import random

import pytest

from tests.llm import brute
from trialspark.llm import neardup


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def make(spark, rows):
    return spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, node string")


def test_clusters_chains_and_edges(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []

    def add(text):
        rows.append((1000 - 3 * len(rows), text))

    base = [rng.choice(words) for _ in range(120)]
    for _ in range(60):  # copies around one text that are often further from each other
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(120)] = rng.choice(words)
        add(" ".join(copy))
    chain = [rng.choice(words) for _ in range(200)]
    for i in range(25):  # neighbours are linked, ends are not
        chain[8 * i % 200] = f"c{i}"
        chain[(8 * i + 1) % 200] = f"d{i}"
        add(" ".join(chain))
    for _ in range(40):  # half a shared passage
        add(" ".join(base[:60] + [rng.choice(words) for _ in range(60)]))
    for text in (None, "", " \n\t ", "one", "ONE", "one two", "one  two", "É one", "é one", "a b c", "a b c"):
        add(text)
    rows += [rows[0], rows[-1], (rows[5][0], "other text of a known key"), (None, "a b c"), (None, None)]
    expected = sorted(brute.near_duplicates(rows, 3, 85), key=str)
    plan = neardup.Plan(words=3, percent=85)
    assert rows_of(neardup.near_duplicates(make(spark, rows), plan)) == expected
    expected = sorted(brute.near_duplicates(rows, 5, 80), key=str)
    assert rows_of(neardup.near_duplicates(make(spark, rows))) == expected


def test_large_bands_in_blocks(spark, monkeypatch):
    """Many copies that are too far from the centre of their bands, over several chunks."""
    rng = random.Random(9)
    monkeypatch.setattr(neardup, "CHUNK", 2000)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(260):
        copy = list(base)
        for j in range(rng.choice((1, 3, 5, 6, 7))):
            copy[rng.randrange(90)] = f"x{rng.randrange(12)}"
        rows.append((i, " ".join(copy)))
    expected = sorted(brute.near_duplicates(rows, 3, 85), key=str)
    assert len({r[2] for r in expected}) > 5
    found = neardup.near_duplicates(make(spark, rows), neardup.Plan(3, 85))
    assert rows_of(found) == expected


def test_blocks_hold_few_classes(spark, monkeypatch):
    """Short texts are few shingles but many classes; every pair still meets in a block."""
    monkeypatch.setattr(neardup, "CLASSES", 50)
    rows = [(7, i, i, 0, 3) for i in range(1000)]
    table = spark.createDataFrame(rows, "band long, node long, root long, main long, n long")
    blocks = {}
    for r in neardup.dealt_blocks(table).collect():
        blocks.setdefault((r.i, r.j), ([], []))[r.side].append(r.node)
    assert max(len(side) for block in blocks.values() for side in block) < 100
    met = [(a, b) for one, other in blocks.values() for a in one for b in other]
    assert len(met) == len(set(met)) == 999 * 1000


def test_empty(spark):
    assert rows_of(neardup.near_duplicates(make(spark, []))) == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = sorted(brute.near_duplicates(rows, 3, 85), key=str)
    assert rows_of(neardup.near_duplicates(docs, neardup.Plan(3, 85))) == expected


@pytest.mark.parametrize("j", [0.3, 0.85, 0.95])
def test_estimate(spark, j):
    import numpy as np
    from pyspark.sql import functions as F

    plan = neardup.Plan(3, 85)
    rng = np.random.default_rng(1)
    numbers = rng.integers(0, 1 << 63, 4000, dtype="u8")
    common = int(2 * 2000 * j / (1 + j))
    a, b = np.sort(numbers[:2000]), np.sort(numbers[2000 - common : 4000 - common])
    table = spark.createDataFrame(
        [(neardup.sketch(a, plan)[0].tolist(), neardup.sketch(b, plan)[0].tolist())],
        "a array<long>, b array<long>",
    )
    found = table.select(neardup.estimate(F.col("a"), F.col("b"), plan)).first()[0]
    true = common / (4000 - common)
    assert abs(found - true) < 0.15
