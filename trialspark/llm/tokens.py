"""Exact token counts by prefix dynamic programming.

A byte-level vocabulary splits text into pieces and merges bytes inside each piece. For every
prefix of a piece exactly one token ends its encoding: the one whose pair with the last token
of the prefix before it survives merging. Walking through the prefixes once therefore gives
the last token and the count of each, and any budget question is a lookup.
"""

from __future__ import annotations

import functools
import json
import re
from bisect import bisect_right
from collections.abc import Sequence

import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from trialspark.llm.common import CACHE_LETTERS, WordCache, map_batches
from trialspark.llm.merges import PairTest

# Fixed value: the split pattern of byte-level vocabularies of this kind.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# Beyond these characters Unicode versions disagree on letters, so the tokenizer's own
# splitter is asked.
WIDE = re.compile("[԰-\U0010ffff]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, others from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PrefixCounter:
    """Counts for every prefix under one vocabulary file of the ``tokenizers`` format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        self.letters = dict(enumerate(byte_letters()))
        specials = sorted((t["content"] for t in described["added_tokens"]), key=len, reverse=True)
        self.special_words = set(specials)
        self.specials = re.compile("(" + "|".join(map(re.escape, specials)) + ")")
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.pairs = PairTest(lambda a, b: self.ranks.get((a, b)))
        self.states = WordCache(self._state)
        self.counts = WordCache(self._count)

    def _state(self, prefix: str) -> tuple[str, int]:
        """Last token and token count of a prefix, from those of the shorter prefixes."""
        if not prefix:
            return "", 0
        end = len(prefix)
        for start in range(max(0, end - self.longest), end):
            token = prefix[start:]
            if token in self.vocab:
                last, count = self.states[prefix[:start]]
                if self.pairs.survive(last, token):
                    return token, count + 1
        raise ValueError(f"no token ends {prefix!r}")

    def spell(self, piece: str) -> str:
        """The piece with one letter per UTF-8 byte."""
        return piece.encode().decode("latin-1").translate(self.letters)

    def table(self, piece: str) -> list[tuple[str, int]]:
        """Last token and token count of every byte prefix of a piece, from the empty one."""
        spelled = self.spell(piece)
        if len(spelled) <= CACHE_LETTERS:
            return [self.states[spelled[:end]] for end in range(len(spelled) + 1)]
        found = [("", 0)]
        for end in range(1, len(spelled) + 1):
            for start in range(max(0, end - self.longest), end):
                token = spelled[start:end]
                if token in self.vocab and self.pairs.survive(found[start][0], token):
                    found.append((token, found[start][1] + 1))
                    break
        return found

    def _count(self, piece: str) -> int:
        spelled = self.spell(piece)
        if len(spelled) <= CACHE_LETTERS:
            return self.states[spelled][1]
        return self.table(piece)[-1][1]

    def piece_tokens(self, piece: str) -> list[str]:
        """Tokens of a piece, recovered from its last prefix backwards."""
        table, tokens = self.table(piece), []
        at = len(table) - 1
        while at:
            tokens.append(table[at][0])
            at -= len(table[at][0])
        return tokens[::-1]

    def encode_piece(self, piece: str) -> list[int]:
        return [self.vocab[token] for token in self.piece_tokens(piece)]

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text; special strings are pieces of their own."""
        if self.special_words and self.specials.search(text):
            found = []
            for part in self.specials.split(text):
                found += [part] if part in self.special_words else self._plain(part)
            return found
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if WIDE.search(text):
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return PIECES.findall(text)

    def count(self, text: str) -> int:
        """Number of tokens of a text."""
        pieces = self.pieces(text)
        if self.special_words and self.specials.search(text):
            return sum(1 if p in self.special_words else self.counts[p] for p in pieces)
        return sum(map(self.counts.__getitem__, pieces))

    def cut(self, text: str, limit: int) -> int:
        """Bytes covered by the first ``limit`` tokens."""
        left, at = limit, 0
        for piece in self.pieces(text):
            special = piece in self.special_words
            need = 1 if special else self.counts[piece]
            if need > left:
                return at + sum(map(len, self.piece_tokens(piece)[:left]))
            left -= need
            at += len(piece.encode())
        return at

    def prefix_counts(self, text: str) -> list[int]:
        """Token count at every byte prefix, the text's pieces kept as they are."""
        counts = [0]
        for piece in self.pieces(text):
            base = counts[-1]
            if piece in self.special_words:
                counts += [base] * (len(piece) - 1) + [base + 1]
            else:
                counts += [base + count for _, count in self.table(piece)[1:]]
        return counts


def bytes_within(counts: Sequence[int], budget: int) -> int:
    """Longest byte prefix whose count is within the budget, from ``prefix_counts``.

    Counts of prefixes may fall again by one token, so the last prefix within it is taken from
    the running minimum of the counts to its right.
    """
    low = list(counts)
    for i in range(len(low) - 2, -1, -1):
        low[i] = min(low[i], low[i + 1])
    return bisect_right(low, budget) - 1


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = 1024, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Tokens of every whole text.

    ``vocabulary`` is the path of the vocabulary file, readable on every executor. Adds
    ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens) and
    ``cut_bytes``: the bytes that the first ``limit`` tokens cover. A missing text counts as an
    empty one; repeated rows are counted each, a missing key stays missing, other columns are
    left out, and an empty table gives an empty one.
    """

    def start():
        tool = counter(vocabulary)

        def work(keys, texts):
            texts = [t or "" for t in texts]
            sizes = [len(t.encode()) for t in texts]
            counts = [tool.count(t) for t in texts]
            return {
                key: keys, "n_bytes": sizes, "n_tokens": counts,
                "over_limit": [n > limit for n in counts],
                "cut_bytes": [
                    tool.cut(t, limit) if n > limit else size
                    for t, n, size in zip(texts, counts, sizes)
                ],
            }

        return work

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(
        docs, [key, text],
        f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long", start,
    )
