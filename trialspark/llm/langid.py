"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialspark.llm.common import SLICE, extend_batches, map_batches, ship

GRAMS = 4  # n-grams of 1 to GRAMS letters
BITS = 16  # hash buckets as a power of two
SMOOTH = 0.5  # added to every count
CELLS = 1 << 20  # numbers in one counting or scoring block
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Languages in order, and the log probability of each bucket (rows) in each of them."""

    languages: tuple[str, ...]
    logs: np.ndarray


@functools.lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letters(text: str) -> np.ndarray:
    """Code points in lower case; whatever is no letter is a space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(letter_table()[codes], codes, 32)


def blocks(texts: Sequence[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of about ``size`` letters at a time, with the texts in them and their starts.

    Texts are set apart by spaces, so no n-gram spans two. A longer text comes in several blocks
    that overlap by GRAMS - 1 letters; those letters are counted in the first of them only.
    """
    gap = np.full(GRAMS - 1, 32, "u4")
    parts, owners, starts, used = [], [], [], 0
    for number, text in enumerate(texts):
        codes = np.concatenate([gap, letters(text)])
        for first in range(0, max(1, len(codes) - len(gap)), size):
            piece = codes[first : first + size + len(gap)]
            if used and used + len(piece) > size:
                yield np.concatenate(parts), np.array(owners), np.array(starts)
                parts, owners, starts, used = [], [], [], 0
            parts.append(piece)
            owners.append(number)
            starts.append(used)
            used += len(piece)
    if used:
        yield np.concatenate(parts), np.array(owners), np.array(starts)


def grams(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of the n-gram that ends at each place, and where it counts.

    An n-gram counts if it has a letter and does not end in the gap before its text.
    """
    real = np.ones(len(codes), bool)
    for back in range(GRAMS - 1):
        real[np.minimum(starts + back, len(codes) - 1)] = False
    letter = codes != 32
    mixed = np.zeros(len(codes), "u4")
    any_letter = np.zeros(len(codes), bool)
    for n in range(GRAMS):
        shifted = codes if n == 0 else np.concatenate([np.full(n, 32, "u4"), codes[:-n]])[: len(codes)]
        any_letter[n:] |= letter[: len(codes) - n]
        mixed = (mixed ^ (shifted + np.uint32(n + 1))) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        yield (mixed * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS), real & any_letter


def bucket_counts(texts: Sequence[str]) -> np.ndarray:
    total = np.zeros(1 << BITS, "i8")
    for codes, _, starts in blocks(texts, CELLS):
        for buckets, counted in grams(codes, starts):
            total += np.bincount(buckets[counted], minlength=1 << BITS)
    return total


def fit(
    docs: DataFrame, rows_per_language: int = 4000, text: str = "text", lang: str = "lang",
    key: str = "doc_id",
) -> Model:
    """Learn from at most about ``rows_per_language`` documents of each language.

    The bound is a parameter: a language with more rows is sampled by a hash of its key. Rows
    without text, language or key are not learned from. Bucket counts are added up on the
    executors; the driver gets one number per language and bucket.
    """
    ship(docs.sparkSession)
    known = docs.select(key, text, lang).dropna()
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not sizes:
        return Model((), np.zeros((1 << BITS, 0), "f4"))
    shares = F.create_map(*(
        F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, rows_per_language / n))
    ))
    spread = F.pmod(F.xxhash64(F.col(key), F.lit("fit")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.where(spread < shares[F.col(lang)]).select(lang, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                names, texts = (c.to_pylist() for c in batch.slice(first, SLICE).columns)
                for name in set(names):
                    own = [t for t, other in zip(texts, names) if other == name]
                    totals[name] = totals.get(name, 0) + bucket_counts(own)
        for name, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([name] * len(used), pa.string()),
                "bucket": pa.array(used.astype("i4")), "n": pa.array(total[used]),
            })

    # The sample is bounded, so a few tasks count it and few partial counts are shuffled.
    counted = (
        sample.repartition(6).mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    languages = tuple(sorted(sizes))
    place = {name: i for i, name in enumerate(languages)}
    counts = np.full((1 << BITS, len(languages)), SMOOTH)
    column = np.array([place[name] for name in counted["lang"].to_pylist()], "i8")
    np.add.at(counts, (counted["bucket"].to_numpy(), column), counted["n"].to_numpy())
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype("f4"))


def score(texts: Sequence[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Language and its posterior probability for each text, under equal priors.

    The n-grams of a block are the rows of a sparse matrix with one text per row; it is
    multiplied with the log probabilities by looking rows up and adding them by text.
    """
    width = max(1, len(model.languages))
    sums = np.zeros((len(texts), len(model.languages)))
    seen = np.zeros(len(texts), "i8")
    for codes, owners, starts in blocks([t or "" for t in texts], CELLS // width):
        for n, (buckets, counted) in enumerate(grams(codes, starts)):
            at = np.flatnonzero(counted)
            if not len(at):
                continue
            first = np.searchsorted(at, starts)
            filled = first < np.append(first[1:], len(at))
            added = np.add.reduceat(model.logs[buckets[at]], first[filled], axis=0, dtype="f8")
            np.add.at(sums, owners[filled], added)
            if n == 0:
                np.add.at(seen, owners, np.diff(np.append(first, len(at))))
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    best = sums.argmax(axis=1)
    top = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    return (
        [model.languages[b] if s else UNKNOWN for b, s in zip(best, seen)],
        [float(p) if s else 0.0 for p, s in zip(top, seen)],
    )


def predict(
    docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` (0 to 1) of every whole text.

    A missing text, or one without a letter, is ``und`` with score 0, and so is every text
    under a model that learned nothing. Repeated rows are scored each, a missing key stays
    missing, other columns are left out, and an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        learned = shared.value

        def work(keys, texts):
            names, scores = score(texts, learned)
            return {key: keys, "lang_pred": names, "score": scores}

        return work

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs, [key, text], f"{key} {kind}, lang_pred string, score double", start)


def label(
    docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the predicted language and its score added under ``names``; as ``predict``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        learned = shared.value
        return lambda texts: dict(zip(names, score(texts, learned)))

    return extend_batches(docs, [text], f"`{names[0]}` string, `{names[1]}` double", start)
