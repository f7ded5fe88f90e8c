"""Packing by length patterns and non-negative least squares.

The pieces' lengths are counted; few-document patterns that fill a sequence are enumerated over
length classes, repeat counts are fitted to the histogram by non-negative least squares and
rounded, and the pieces left over are packed best-fit into the space that is left. All of this
works on counts of lengths, so it does not grow with the corpus. Executors then number the
pieces of each length and look up their places.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from trialspark.llm.common import SLICE, WordCache, settle, ship

# Fixed value: the split pattern of vocabularies of this kind, after lower-casing.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Below these characters lower case and composition work letter by letter; the rest is left to
# the tokenizer as a whole.
PLAIN = re.compile("[\x21-\x7e\xa1-˿]+")
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
SPACE = re.compile("[\t-\r ]+")


# The same for whole texts of such characters, where \p{L} and \p{N} can be said without tables;
# fractions and raised digits are numbers.
PLAIN_TEXT = re.compile("[\t-\r \x21-\x7e\xa1-\u02ff]*")
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
BREAK = re.compile("[\t-\r ]")
# Longer texts are taken in stretches of about so many characters, broken at white space.
STRETCH = 1 << 18


class WordEncoder:
    """Token ids of texts under a vocabulary whose words do not run over white space.

    Words come from the tokenizer once and are remembered.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        specials = [re.escape(t["content"]) for t in described["added_tokens"]]
        self.specials = re.compile("|".join(specials) or "(?!)")
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        self.letters = {b: b if b in shown else next(hidden) for b in range(256)}
        self.words = WordCache(self._word)
        self.chunks = WordCache(self._chunk)

    def _word(self, word: str) -> bytes:
        spelled = word
        if not (word.isascii() and word.isalnum()):
            spelled = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self.words[chunk.lower()]
        if not PLAIN.fullmatch(chunk) or self.specials.search(chunk):
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        return b"".join(map(self.words.__getitem__, WORDS.findall(chunk.lower())))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(text) <= STRETCH:
            return self._stretch(text)
        parts, at = [], 0
        while at < len(text):
            # Words and special strings do not run over white space.
            end = BREAK.search(text, min(at + STRETCH, len(text)))
            end = end.end() if end else len(text)
            parts.append(self._stretch(text[at:end]))
            at = end
        return b"".join(parts)

    def _stretch(self, text: str) -> bytes:
        if PLAIN_TEXT.fullmatch(text) and not self.specials.search(text):
            return b"".join(map(self.words.__getitem__, PLAIN_WORDS.findall(text.lower())))
        chunks = SPACE.split(text) if ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by active sets: ``x >= 0`` with ``|ax - b|`` least."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    tiny = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tiny:
            break
        active[best] = True
        while True:
            fitted = np.zeros_like(x)
            fitted[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (fitted <= 0)
            if not low.any():
                x = fitted
                break
            step = (x[low] / (x[low] - fitted[low])).min()
            x = x + step * (fitted - x)
            active &= x > tiny
            x[~active] = 0
    return x


def patterns(classes: int, parts: int) -> list[tuple[int, ...]]:
    """All ways of up to ``parts`` classes, largest first, that add up to ``classes``."""
    found = []

    def extend(chosen: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) < parts:
            for c in range(min(left, most), 0, -1):
                if c * (parts - len(chosen)) < left:
                    break
                extend((*chosen, c), left - c, c)

    extend((), classes, classes)
    return found


@dataclass
class Group:
    """``count`` sequences that hold the same lengths: how often each."""

    count: int
    lengths: dict[int, int]

    @property
    def used(self) -> int:
        return sum(length * n for length, n in self.lengths.items())


def plan(histogram: dict[int, int], capacity: int, classes: int = 64, parts: int = 4) -> list[Group]:
    """Sequences for all pieces, as groups of equal ones.

    A class is a stretch of ``capacity / classes`` lengths, and a pattern holds at most
    ``parts`` classes. Each class counts as its longest length, so every pattern fits.
    Fitted counts are rounded down; what remains is packed longest first, each time into
    the sequences with the least space that takes it. All pieces of a length go in one step.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    width = -(-capacity // classes)
    of = lambda length: -(-length // width)
    target = np.zeros(classes + 1)
    for length, count in left.items():
        target[of(length)] += count
    usable = [p for p in patterns(classes, parts) if all(target[c] for c in p)]
    groups: list[Group] = []
    if usable:
        matrix = np.zeros((classes + 1, len(usable)))
        for i, p in enumerate(usable):
            for c in p:
                matrix[c, i] += 1
        # Long pieces are hard to place later, so their misfit weighs more.
        weight = np.arange(classes + 1) / classes
        repeats = nnls(matrix * weight[:, None], target * weight)
        have = sorted(left)
        for i in np.argsort(-repeats, kind="stable"):
            wanted = int(repeats[i] + 1e-6)
            while wanted > 0:
                chosen = _realise(usable[i], have, left, width, capacity)
                if chosen is None:
                    break
                count = min(wanted, *(left[x] // n for x, n in chosen.items()))
                groups.append(Group(count, chosen))
                wanted -= count
                for x, n in chosen.items():
                    left[x] -= n * count
                have = [x for x in have if left[x]]
    return _best_fit(groups, left, capacity)


def _realise(
    pattern: tuple[int, ...], have: list[int], left: dict[int, int], width: int, capacity: int
) -> dict[int, int] | None:
    """Lengths for a pattern: the longest of each class, and last whatever fills the rest best.

    ``have`` lists the lengths of which ``left`` holds some. None if a class has run out.
    """
    chosen: dict[int, int] = {}
    space = capacity
    for part, c in enumerate(pattern):
        most = space if part == len(pattern) - 1 else c * width
        at = bisect.bisect_right(have, most) - 1
        while at >= 0 and left[have[at]] <= chosen.get(have[at], 0):
            at -= 1
        if at < 0 or have[at] <= (c - 1) * width:
            return None
        chosen[have[at]] = chosen.get(have[at], 0) + 1
        space -= have[at]
    return chosen


def _best_fit(groups: list[Group], left: dict[int, int], capacity: int) -> list[Group]:
    spaces: dict[int, list[Group]] = defaultdict(list)
    order: list[int] = []

    def put(group: Group) -> None:
        space = capacity - group.used
        if space not in spaces:
            bisect.insort(order, space)
        spaces[space].append(group)

    for group in groups:
        put(group)
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                full, rest = divmod(count, each)
                if full:
                    put(Group(full, {length: each}))
                if rest:
                    put(Group(1, {length: rest}))
                break
            space = order[at]
            group = spaces[space].pop()
            if not spaces[space]:
                del spaces[space], order[at]
            each = min(space // length, count)
            full = min(group.count, count // each)
            if full < group.count:
                put(Group(group.count - full, group.lengths))
            put(Group(full, {**group.lengths, length: group.lengths.get(length, 0) + each}))
            count -= full * each
    return [g for held in spaces.values() for g in held]


def places(groups: list[Group]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of a length go, by their number among the pieces of that length.

    Rows are (length, first number, end, pieces per sequence, first sequence, offset).
    """
    rows, number, sequence = [], defaultdict(int), 0
    for group in groups:
        offset = 0
        for length in sorted(group.lengths, reverse=True):
            each = group.lengths[length]
            first = number[length]
            number[length] += group.count * each
            rows.append((length, first, number[length], each, sequence, offset))
            offset += length * each
        sequence += group.count
    return rows


def measure(
    docs: DataFrame, vocabulary: str, capacity: int, stop: int, text: str, key: str
) -> DataFrame:
    """One row per piece, numbered among the pieces of its length in its partition."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = T._parse_datatype_string(
        f"doc {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, "
        "part int, place long"
    )
    target = pa.schema([
        ("doc", to_arrow_type(kind)), ("piece", pa.int32()),
        ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("part", pa.int32()), ("place", pa.int64()),
    ])
    ending = np.array([stop], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches):
        from pyspark import TaskContext

        tool, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                keys, texts = (c.to_pylist() for c in batch.slice(first, SLICE).columns)
                rows = []
                for k, t in zip(keys, texts):
                    ids = tool.encode(t or "") + ending
                    for piece, at in enumerate(range(0, len(ids), step)):
                        own = ids[at : at + step]
                        length = len(own) // 4
                        rows.append((k, piece, at // 4, length, zlib.crc32(own), part, seen[length]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target
                )

    return docs.select(key, text).mapInArrow(cut, schema)


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, stop: int = 0,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    A document is the ids of its text and then ``stop``; a longer one is cut into pieces of
    ``capacity`` tokens. Gives per piece: ``key``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id`` and ``offset``. A missing text is an empty one; repeated rows
    are packed each, a missing key stays missing, other columns are left out, and an empty table
    gives an empty one.

    The driver gets one count per length and sends back the places of groups of equal
    sequences; both are bounded by the capacity, whatever the corpus.
    """
    spark = docs.sparkSession
    pieces = settle(measure(docs, vocabulary, capacity, stop, text, key))
    counted = settle(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {
        row.length: row.n
        for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()
    }
    rows = places(plan(histogram, capacity))
    table = spark.createDataFrame(
        rows, "len long, first long, end long, each long, sequence long, offset long"
    )
    # Earlier partitions' pieces of the same length come first.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = settle(
        counted.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    )
    number = F.col("place") + F.col("shift")
    numbered = pieces.join(shifts, ["length", "part"]).withColumn("number", number)
    step = F.col("number") - F.col("first")
    return numbered.join(
        F.broadcast(table),
        (F.col("length") == F.col("len")) & (F.col("number") >= F.col("first"))
        & (F.col("number") < F.col("end")),
    ).select(
        F.col("doc").alias(key), "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset") + (step % F.col("each")) * F.col("length")).alias("offset"),
    )
