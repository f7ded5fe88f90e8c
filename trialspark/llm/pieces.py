"""SentencePiece encoding and decoding by a merge-type prefix table.

Spaces become a visible mark, and no piece of the vocabulary runs from another letter into a
mark, so a text falls into words that start with marks. In a word every prefix has one last
token: of the pieces that an automaton finds to end there, the one compatible with the last
token of the prefix before it. The ids are read from the table backwards.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from trialspark.llm.common import WordCache, map_batches
from trialspark.llm.merges import PairTest

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: piece types of the model format
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceTable:
    """Encoder for a merge-type model file with byte fallback and no text normalisation."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces:
            raise ValueError(f"{path} is not a merge-type model over plain text")
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in self.ids):
            raise ValueError(f"{path} has pieces that run over a space")
        scores = sorted({model.pieces[i].score for i in self.ids.values()}, reverse=True)
        order = {score: rank for rank, score in enumerate(scores)}
        ranks = {piece: order[model.pieces[i].score] for piece, i in self.ids.items()}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.pairs = PairTest(lambda a, b: ranks.get(a + b))
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.words = WordCache(lambda word: np.array(self.encode_word(word), "<u4").tobytes())

    def table(self, word: str) -> list[str]:
        """Last token of every prefix of a word, from the empty one.

        A single letter is tried after the longer pieces; a letter without a piece is a token
        that nothing merges with.
        """
        last = [""] + [None] * len(word)
        at = 0
        survive = self.pairs.survive
        for end, piece in self.automaton.iter(word):
            end += 1
            while at + 1 < end:  # prefixes that no longer piece ends
                at += 1
                last[at] = last[at] or word[at - 1]
            if last[end] is None and survive(last[end - len(piece)], piece):
                last[end] = piece
        while at < len(word):
            at += 1
            last[at] = last[at] or word[at - 1]
        return last

    def tokens(self, word: str) -> list[str]:
        """Tokens of a word, from its last prefix backwards."""
        if word.startswith(MARK * 2):
            # Pieces of several marks share one score: no strict order, so no prefix table.
            # Merging settles the marks and what they reach; marks never follow other letters.
            return self.pairs.merge(word)[0]
        last, at, found = self.table(word), len(word), []
        while at:
            found.append(last[at])
            at -= len(last[at])
        return found[::-1]

    def encode_word(self, word: str) -> list[int]:
        ids = []
        for token in self.tokens(word):
            number = self.ids.get(token)
            ids += [number] if number is not None else [self.bytes[b] for b in token.encode()]
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text with begin and end, as little-endian unsigned 32-bit integers."""
        edges = np.array([self.begin, self.end], "<u4").tobytes()
        if not text:
            return edges
        words = WORDS.findall(self.prefix + text.replace(" ", MARK))
        return edges[:4] + b"".join(map(self.words.__getitem__, words)) + edges[4:]

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


@functools.lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def encode(
    docs: DataFrame, model: str, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Ids of every whole text, with begin and end ids: ``key`` and ``ids``, an array of ints.

    ``model`` is the path of the model file, readable on every executor. A missing text is
    encoded as an empty one; repeated rows are encoded each, a missing key stays missing, other
    columns are left out, and an empty table gives an empty one.
    """

    def start():
        table = piece_table(model)

        def work(keys, texts):
            return {key: keys, "ids": [
                np.frombuffer(table.encode(t or ""), "<u4").astype("i4") for t in texts
            ]}

        return work

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs, [key, text], f"{key} {kind}, ids array<int>", start)


def decode(
    encoded: DataFrame, model: str, ids: str = "ids", key: str = "doc_id"
) -> DataFrame:
    """Texts of id arrays: ``key`` and ``text``. Missing ids give an empty text."""

    def start():
        table = piece_table(model)
        return lambda keys, rows: {
            key: keys, "text": [table.library.decode(row or []) for row in rows]
        }

    kind = encoded.schema[key].dataType.simpleString()
    return map_batches(encoded, [key, ids], f"{key} {kind}, text string", start)


def round_trip(
    docs: DataFrame, model: str, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Encode and decode every whole text and keep the digests, without moving the ids.

    Gives ``key``, ``n_tokens`` (all ids), ``ids_sha256``, ``decoded_sha256`` and ``same``:
    whether decoding gives the text back. Cases as in ``encode``; a missing text is the same
    as an empty one.
    """

    def start():
        table = piece_table(model)

        def work(keys, texts):
            out = {name: [] for name in ("n_tokens", "ids_sha256", "decoded_sha256", "same")}
            for t in texts:
                ids = table.encode(t or "")
                decoded = table.decode(ids)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                out["same"].append(decoded == (t or ""))
            return {key: keys, **out}

        return work

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(
        docs, [key, text],
        f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean",
        start,
    )
