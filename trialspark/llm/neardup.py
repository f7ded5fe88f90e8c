"""Near duplicates by b-bit MinHash.

Each document's set of word shingles gives one minimum per hash function. Bands of minima find
candidates; the low bits of all minima, packed into a few numbers, estimate the similarity of a
candidate pair by bit counts, corrected for low bits that agree by chance; what may reach the
threshold is confirmed on the full sets.

Copies share a set and count as one class. Inside a band no pairs are formed at first: every
class is held against one centre of its bands, the class with the most company, and classes that
the confirmed links already join need no further pair. Only classes of different components
that still share a band are compared, each outside the main component of its band with all others:
in small bands by a join, in large ones in blocks of full sets that give back no more links than
hold their classes together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from trialspark.llm.common import WordCache, map_batches, settle
from trialspark.llm.components import components, forest_roots

MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 2048  # shingles hashed at once
SMALL = 64  # rows of a band that are paired by a join; larger bands are compared in blocks
CHUNK = 64_000  # shingles on one side of a block
CLASSES = 2000  # classes on one side of a block, whose counts of common shingles are a matrix


@dataclass(frozen=True)
class Plan:
    """How sets are made, sketched and compared.

    ``words`` per shingle and ``percent`` similarity are the task. Bands of ``rows`` minima are
    as many as let a pair at the threshold be missed with probability ``miss`` at most; ``bits``
    low bits are kept of each minimum, and a pair is confirmed on its sets unless its estimate
    is ``margin`` standard errors below the threshold.
    """

    words: int = 5
    percent: int = 80
    rows: int = 5
    bits: int = 2
    miss: float = 1e-7
    margin: float = 5.0

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def longs(self) -> int:
        return math.ceil(self.hashes * self.bits / 64)

    @property
    def floor(self) -> float:
        """Least estimate that is confirmed."""
        chance, j = 2.0**-self.bits, self.percent / 100
        agree = j + (1 - j) * chance
        return j - self.margin * math.sqrt(agree * (1 - agree) / self.hashes) / (1 - chance)


def finish(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def word_hashes() -> WordCache:
    return WordCache(xxhash.xxh64_intdigest)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles.

    Letters A-Z count as a-z and words end at ASCII white space. A text of fewer words is one
    shingle; without words the set is empty.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, "u8")
    hashed = np.fromiter(map(word_hashes().__getitem__, parts), "u8", len(parts))
    size = min(words, len(parts))
    mixed = np.zeros(len(parts) - size + 1, "u8")
    for i in range(size):
        mixed = mixed * MIX + hashed[i : len(parts) - size + 1 + i]
    return np.unique(finish(mixed + np.uint64(size)))


@lru_cache(maxsize=4)
def functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240)
    a, b = rng.integers(1, 1 << 63, (2, count, 1), dtype="u8")
    return a * np.uint64(2) + np.uint64(1), b * np.uint64(2)


def sketch(shingles: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits of the minima, and one key per band."""
    a, b = functions(plan.hashes)
    least = np.full(plan.hashes, np.iinfo("u8").max, "u8")
    for first in range(0, len(shingles), BLOCK):
        least = np.minimum(least, (a * shingles[first : first + BLOCK] + b).min(axis=1))
    least >>= np.uint64(32)
    low = np.zeros(plan.longs * 64 // plan.bits, "u8")
    low[: plan.hashes] = least & np.uint64((1 << plan.bits) - 1)
    places = np.arange(64 // plan.bits, dtype="u8") * np.uint64(plan.bits)
    packed = (low.reshape(plan.longs, -1) << places).sum(axis=1, dtype="u8")
    keys = np.arange(1, plan.bands + 1, dtype="u8")
    for column in least.reshape(plan.bands, plan.rows).T:
        keys = finish(keys * MIX + column)
    return packed.view("i8"), keys.view("i8")


def class_id(shingles: np.ndarray) -> int:
    """64-bit id of a set, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype("i8"))


def estimate(mine: Column, theirs: Column, plan: Plan) -> Column:
    """Similarity from two packed signatures, corrected for chance agreement."""
    mask = sum(1 << i for i in range(0, 64, plan.bits))
    mask = mask - (1 << 64) if mask >> 63 else mask

    def unlike(i: int) -> Column:
        x = mine[i].bitwiseXOR(theirs[i])
        step = 1
        while step < plan.bits:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        return F.bit_count(x.bitwiseAND(F.lit(mask)))

    agree = 1 - reduce(Column.__add__, map(unlike, range(plan.longs))) / F.lit(float(plan.hashes))
    chance = 2.0**-plan.bits
    return (agree - chance) / (1 - chance)


def confirmed(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Pairs ``a``, ``b`` whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    counted = pairs.join(left, "a").join(right, "b").select(
        "a", "b", both.cast("long").alias("common"),
        (F.size("sa") + F.size("sb") - both).cast("long").alias("all"),
    )
    return counted.where(F.col("common") * 100 >= F.col("all") * plan.percent).select("a", "b").distinct()


def spanning_links(one: list, other: list, percent: int) -> list[tuple[int, int]]:
    """Links between the roots of two lists of (root, set), as few as join what is linked.

    The common shingles of all pairs are counted by products of slices of the membership
    matrices, so memory is bounded by the product of the numbers of sets.
    """
    sets = [s for _, s in one + other]
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(column) > 1
    place = np.cumsum(often) - 1
    row, column = row[often[column]], place[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cut, width = len(one), 2048
    common = np.zeros((cut, len(other)))
    for first in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(column, [first, first + width])
        member = np.zeros((len(sets), width), "f4")
        member[row[lo:hi], column[lo:hi] - first] = 1
        common += member[:cut] @ member[cut:].T
    union = sizes[:cut, None] + sizes[None, cut:] - common
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    found = []
    for i, j in zip(*np.nonzero(common * 100 >= union * percent)):
        a, b = one[i][0], other[j][0]
        if top(a) != top(b):
            parent[top(a)] = top(b)
            found.append((a, b))
    return found


def links_in_blocks(rows: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Links ``a``, ``b`` between the roots of bands given as ``band, node, root, main, n``.

    Classes outside the main component are dealt into chunks, all classes into others, and
    every pair of chunks is compared in a task of its own.
    """

    def compare(table: pa.Table) -> pa.Table:
        lists: tuple[list, list] = ([], [])
        columns = (table[c].to_pylist() for c in ("side", "root"))
        for s, root, shingles in zip(*columns, table["shingles"]):
            lists[s].append((root, shingles.values.to_numpy()))
        found = spanning_links(*lists, plan.percent) if all(lists) else []
        return pa.table({
            "a": pa.array([a for a, _ in found], pa.int64()),
            "b": pa.array([b for _, b in found], pa.int64()),
        })

    return (
        dealt_blocks(rows).join(sets, "node").select("band", "i", "j", "side", "root", "shingles")
        .groupBy("band", "i", "j").applyInArrow(compare, "a long, b long")
    )


def dealt_blocks(rows: DataFrame) -> DataFrame:
    """``band, node, root, side, i, j``: members of every pair of chunks, side 0 from outside.

    Chunks hold about CHUNK shingles and about CLASSES classes at most.
    """
    outside = F.col("root") != F.col("main")
    parts = settle(rows.groupBy("band").agg(
        F.greatest(
            F.ceil(F.sum(F.when(outside, F.col("n")).otherwise(0)) / CHUNK),
            F.ceil(F.count_if(outside) / CLASSES),
        ).alias("ours"),
        F.greatest(F.ceil(F.sum("n") / CHUNK), F.ceil(F.count("*") / CLASSES)).alias("theirs"),
    ))
    dealt = rows.join(parts, "band").withColumn("spread", F.xxhash64("node"))

    def side(number: int, chosen: DataFrame, own: str, others: str) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)).alias("copy")
        part = F.pmod("spread", own).alias("part")
        return chosen.select("band", "node", "root", part, copies).select(
            "band", "node", "root", F.lit(number).alias("side"),
            F.col("part" if number == 0 else "copy").alias("i"),
            F.col("copy" if number == 0 else "part").alias("j"),
        )

    return side(0, dealt.where(outside), "ours", "theirs").union(
        side(1, dealt, "theirs", "ours")
    )


def near_duplicates(
    docs: DataFrame, plan: Plan = Plan(), text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``kept`` of every document.

    Documents are linked if the similarity of their sets is at least ``plan.percent``;
    ``component_id`` is the smallest key reachable over links, and ``kept`` says that it is the
    document's own. A document without words, a missing text included, is linked with nothing.
    A document without a key is linked with nothing either: its ``component_id`` is missing and
    it is kept. Repeated rows get the same result; several texts under one key are documents
    of their own that share their number. Other columns are left out, and an empty table gives
    an empty one.
    """

    def start():
        def work(keys, texts):
            out = {"k": keys, "n": [], "node": [], "sig": [], "bands": []}
            for k, t in zip(keys, texts):
                shingles = shingle_set(t, plan.words)
                live = len(shingles) and k is not None
                sig, bands = sketch(shingles, plan) if live else (None, None)
                out["n"].append(len(shingles))
                out["node"].append(class_id(shingles) if live else None)
                out["sig"].append(sig)
                out["bands"].append(bands)
            return out

        return work

    kind = docs.schema[key].dataType.simpleString()
    sketched = settle(map_batches(
        docs, [key, text], f"k {kind}, n long, node long, sig array<long>, bands array<long>", start
    ))
    classes = settle(
        sketched.where(F.col("node").isNotNull()).groupBy("node").agg(
            F.min("k").alias("low"), F.max("n").alias("n"),
            F.first("sig").alias("sig"), F.first("bands").alias("bands"),
        )
    )
    marks = classes.select("node", "n", "sig")

    # Bands with company. What is joined is a written table, so that both sides are dealt anew
    # and adaptive execution can split a very common band.
    rows = classes.select("node", F.explode("bands").alias("band"))
    shared = settle(rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"))
    live = settle(rows.join(shared, "band"))
    company = live.groupBy("node").agg(F.sum("size").alias("company"))
    weighed = live.select("band", "node").join(company, "node")
    centres = settle(
        weighed.groupBy("band").agg(F.max(F.struct("company", "node")).alias("top"))
        .select("band", F.col("top.node").alias("centre"), F.col("top.company").alias("company"))
    )

    def compared(pairs: DataFrame) -> DataFrame:
        """Pairs ``a``, ``b`` with their estimate, if it and the set sizes let them be links."""
        left, right = (
            marks.select(*(F.col(c).alias(f"{c}_{side}") for c in marks.columns)) for side in "ab"
        )
        sized = pairs.join(left, F.col("a") == F.col("node_a")).join(
            right, F.col("b") == F.col("node_b")
        )
        return sized.where(alike("a", "b")).select(
            *pairs.columns, estimate(F.col("sig_a"), F.col("sig_b"), plan).alias("estimate")
        )

    def alike(a: str, b: str) -> Column:
        na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
        sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * plan.percent
        return sizes & (estimate(F.col(f"sig_{a}"), F.col(f"sig_{b}"), plan) >= plan.floor)

    # Every class against the best of its centres.
    to_centres = (
        live.join(centres, "band").where("node <> centre")
        .select(F.col("node").alias("a"), F.col("centre").alias("b"), "company").distinct()
    )
    best = settle(
        compared(to_centres).groupBy("a")
        .agg(F.max(F.struct("estimate", "company", "b")).alias("best"))
        .select("a", F.col("best.b").alias("b"))
    )
    sets = shingle_sets(docs, classes, best, plan, text, key)
    roots = forest_roots(
        confirmed(best, sets, plan).select(F.col("a").alias("node"), F.col("b").alias("parent"))
    )

    # Bands that still hold several components.
    placed = settle(
        live.select("band", "node").join(roots, "node", "left")
        .select("band", "node", F.coalesce("root", "node").alias("root"))
    )
    centre_roots = centres.select("band", F.col("centre").alias("node")).join(roots, "node", "left")
    mixed = settle(
        placed.groupBy("band").agg(
            F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size")
        )
        .where("least <> most").select("band", "size")
        .join(centre_roots.select("band", F.coalesce("root", "node").alias("main")), "band")
    )
    open_ = settle(placed.join(mixed, "band").join(marks, "node"))
    one, other = (
        open_.where(F.col("size") <= SMALL).select(
            "band", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "n", "sig", "main"))
        )
        for side in "ab"
    )
    pairs = settle(
        one.where("root_a <> main_a").join(other, "band")
        .where("root_a <> root_b and (root_b = main_b or node_a < node_b)").where(alike("a", "b"))
        .select(
            F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"),
        ).distinct()
    )
    large = open_.where(F.col("size") > SMALL).select("band", "node", "root", "main", "n")
    met = pairs.union(large.select("node", "node"))
    more = shingle_sets(docs, classes, met, plan, text, key)
    links = confirmed(pairs, more, plan)
    joined = components(
        links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
        .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        .union(links_in_blocks(large, more, plan))
    )

    # Smallest key of each component, for every class.
    rooted = settle(
        classes.select("node", "low").join(roots, "node", "left")
        .select("node", "low", F.coalesce("root", "node").alias("root"))
        .join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
        .select("node", "low", F.coalesce("top", "root").alias("root"))
    )
    lowest = settle(rooted.groupBy("root").agg(F.min("low").alias("component_id")))
    named = settle(rooted.join(lowest, "root").select("node", "component_id"))
    own = F.when(F.col("node").isNull(), F.col("k")).otherwise(F.col("component_id"))
    return sketched.select("k", "n", "node").join(named, "node", "left").select(
        F.col("k").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"),
        F.coalesce(own == F.col("k"), F.lit(True)).alias("kept"),
    )


def shingle_sets(
    docs: DataFrame, classes: DataFrame, pairs: DataFrame, plan: Plan, text: str, key: str
) -> DataFrame:
    """``node`` and ``shingles`` of the classes in ``pairs``, from one document of each."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    wanted = settle(
        nodes.distinct().join(classes.select("node", "low"), "node")
        .select(F.col("node").alias("want"), F.col("low").alias("low_key"))
    )
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(
        wanted.hint("shuffle_hash"), F.col("k") == F.col("low_key")
    )

    def start():
        seen = set()

        def work(want, texts):
            out = {"node": [], "shingles": []}
            for node, t in zip(want, texts):
                # Repeated rows come to the same task, but for the few where Spark splits it.
                shingles = shingle_set(t, plan.words) if node not in seen else ()
                if len(shingles) and class_id(shingles) == node:  # a key may have several texts
                    seen.add(node)
                    out["node"].append(node)
                    out["shingles"].append(shingles.view("i8"))
            return out

        return work

    return settle(map_batches(texts, ["want", "t"], "node long, shingles array<long>", start))
