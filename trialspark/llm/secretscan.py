"""Secret scans by grammar inference.

Labelled credentials give a prefix tree; states whose outgoing frequencies are statistically
alike are merged, which leaves a probabilistic automaton per kind of credential. Every token of
a text that could be a secret is scored by how much likelier the best automaton makes it than an
automaton of ordinary tokens does.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trialspark.llm.boosting import threshold
from trialspark.llm.common import map_batches, ship
from trialspark.llm.spans import Cover, Span, as_string, digest, in_order, replace

KINDS = ("assign", "access", "hex", "grammar")

# The base formats. ``[a-z]`` in the names stands for either case.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]++")
LONG_HEX = re.compile(r"[0-9a-f]{32}")
# Candidates: unbroken tokens of any length, and such tokens joined by single dots, but no rules
# of one repeated character. A run is taken whole and never given back, so time is in proportion
# to the text.
TOKEN = re.compile(
    r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+(?:\.[A-Za-z0-9+/_=-]{16,}+)*+"
)
ONE = re.compile(r"(.)\1*+")
END = "\0"
VOWELS, RARE = "aeiouy", "jkqvwxz"
# Letters by case and by how words use them, so that chance letters differ from words.
CLASS = {
    **dict.fromkeys("0123456789", "0"),
    **{c: "a" if c in VOWELS else "q" if c in RARE else "b" for c in "abcdefghijklmnopqrstuvwxyz"},
    **{c: "A" if c.lower() in VOWELS else "Q" if c.lower() in RARE else "B"
       for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"},
}
CLASSES = str.maketrans(CLASS)
WIDTH = {symbol: math.log(list(CLASS.values()).count(symbol)) for symbol in CLASS.values()}
FIXED = 6  # letters at the beginning that stand for themselves


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check."""
    found: list[Span] = [
        ("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8
    ]
    if "AKIA" in text:
        found += [
            ("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16
        ]
    at = LONG_HEX.search(text)
    while at:
        # The match found starts its run: an earlier start would have been found before.
        run = HEX.match(text, at.start())
        found.append(("hex", run.start(), run.end()))
        at = LONG_HEX.search(text, run.end())
    return in_order(found, KINDS)


def candidates(text: str) -> list[Span]:
    return [
        ("grammar", m.start(), m.end()) for m in TOKEN.finditer(text) if ONE.fullmatch(m[0]) is None
    ]


def shape(token: str, fixed: int = FIXED) -> str:
    """The token in symbols of the grammar.

    The first ``fixed`` letters stand for themselves, so that fixed beginnings are learned; later
    ones become classes: vowel, rare or other letter of either case, digit, or the mark itself.
    """
    return token[:fixed] + token[fixed:].translate(CLASSES) + END


@dataclass
class Automaton:
    """Probabilistic automaton: per state, the next state and log probability of a symbol.

    Symbols a state has not seen get ``unseen`` and lead to the state itself.
    """

    step: list[dict[str, tuple[int, float]]]
    unseen: list[float]

    def score(self, symbols: str) -> float:
        """Mean log probability of a symbol."""
        state, total = 0, 0.0
        for symbol in symbols:
            known = self.step[state].get(symbol)
            if known is None:
                total += self.unseen[state]
            else:
                state, logp = known
                total += logp
        return total / len(symbols)


def infer(
    examples: Iterable[str], alpha: float = 0.05, alphabet: int = 72, states: int = 200_000
) -> Automaton:
    """Merge the states of the examples' prefix tree whose frequencies are alike.

    Two states are alike if for every symbol the shares differ by less than the Hoeffding bound
    at level ``alpha``, and so are their successors. Settled states are compared in the order
    in which they were settled, and the state with the least prefix is tried next. The tree
    stops growing at ``states`` states, about 100 MB; an example is counted as far as it goes.
    """
    next_: list[dict[str, int]] = [{}]
    count: list[dict[str, int]] = [{}]
    for word in examples:
        state = 0
        for symbol in word:
            if symbol not in next_[state] and len(next_) >= states:
                break
            count[state][symbol] = count[state].get(symbol, 0) + 1
            if symbol not in next_[state]:
                next_[state][symbol] = len(next_)
                next_.append({})
                count.append({})
            state = next_[state][symbol]
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(a: int, b: int) -> bool:
        pending = [(a, b)]
        while pending:
            a, b = pending.pop()
            na, nb = sum(count[a].values()), sum(count[b].values())
            if not na or not nb:
                continue
            allowed = bound * (na**-0.5 + nb**-0.5)
            for symbol in {*count[a], *count[b]}:
                if abs(count[a].get(symbol, 0) / na - count[b].get(symbol, 0) / nb) > allowed:
                    return False
                if symbol in next_[a] and symbol in next_[b]:
                    pending.append((next_[a][symbol], next_[b][symbol]))
        return True

    def fold(a: int, b: int) -> None:
        pending = [(a, b)]
        while pending:
            a, b = pending.pop()
            for symbol, n in count[b].items():
                count[a][symbol] = count[a].get(symbol, 0) + n
            for symbol, target in next_[b].items():
                if symbol in next_[a]:
                    pending.append((next_[a][symbol], target))
                else:
                    next_[a][symbol] = target

    settled, open_ = [0], [(0, s) for s in sorted(next_[0])]
    while open_:
        state, symbol = open_.pop(0)
        target = next_[state][symbol]
        if target in settled:
            continue
        for known in settled:
            if alike(known, target):
                next_[state][symbol] = known
                fold(known, target)
                break
        else:
            settled.append(target)
        listed = set(open_)
        open_ += [
            (s, x) for s in settled for x in sorted(next_[s])
            if next_[s][x] not in settled and (s, x) not in listed
        ]
    place = {state: i for i, state in enumerate(settled)}
    step, unseen = [], []
    for state in settled:
        total = sum(count[state].values()) + 0.5 * alphabet
        step.append({
            s: (place.get(next_[state].get(s), 0), math.log((n + 0.5) / total))
            for s, n in count[state].items()
        })
        unseen.append(math.log(0.5 / total))
    return Automaton(step, unseen)


def written_credentials(per_kind: int = 150, seed: int = 11) -> dict[str, list[str]]:
    """Labelled credentials of public formats, made by rule, and look-alikes under ``plain``."""
    rng = random.Random(seed)
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    mixed = upper + lower + digit
    syllables = ("tion", "er", "an", "the", "ing", "ou", "re", "st", "le", "on", "ar", "men")
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 5)))
    makers = {
        "assign": lambda: some(mixed, rng.randint(20, 40)),
        "upper": lambda: some(upper, rng.randint(20, 40)),
        "lower": lambda: some(lower, rng.randint(20, 40)),
        "access": lambda: "AKIA" + some(upper + digit, 16),
        "hosted": lambda: rng.choice(("ghp_", "gho_", "ghs_")) + some(mixed, 36),
        "chat": lambda: rng.choice(("xoxb-", "xoxp-")) + some(digit, 12) + "-" + some(mixed, 24),
        "payment": lambda: rng.choice(("sk_live_", "rk_live_")) + some(mixed, 24),
        "cloud": lambda: "AIza" + some(mixed + "-_", 35),
        "signed": lambda: "eyJhbG" + some(mixed, rng.randint(30, 60)) + rng.choice((
            "", ".eyJ" + some(mixed, rng.randint(30, 60)) + "." + some(mixed + "-_", 43),
        )),
        "plain": lambda: rng.choice((
            lambda: "-".join(word() for _ in range(rng.randint(3, 5))),
            lambda: "_".join(word() for _ in range(3)) + some(digit, rng.randint(1, 3)),
            lambda: word() + word().capitalize() + word().capitalize() + word().capitalize(),
            lambda: "/".join(word() for _ in range(4)) + some(digit, 1),
            lambda: f"{some(digit, 4)}-{some(digit, 2)}-{some(digit, 2)}-{word()}{word()}",
            lambda: some(digit, rng.randint(16, 24)),
            lambda: (word() + word() + word() + word()).upper() + some(digit, 2),
            lambda: "-" * rng.randint(16, 40) + some(digit, 1),
            lambda: "".join(word() for _ in range(rng.randint(3, 6))),
            lambda: "".join(word() for _ in range(rng.randint(3, 6))).upper(),
            lambda: "".join(word() for _ in range(rng.randint(3, 6))).capitalize(),
            lambda: rng.choice("-_/").join(word() for _ in range(rng.randint(4, 60))),
        ))(),
    }
    return {kind: [make() for _ in range(per_kind * (6 if kind == "plain" else 1))] for kind, make in makers.items()}


@dataclass
class Grammar:
    """One automaton per kind of credential, two of ordinary tokens, and the decision cut.

    ``plain`` knows the beginnings of ordinary tokens, ``loose`` only their classes, so that a
    word with a new beginning is still a word.
    """

    kinds: dict[str, Automaton]
    plain: Automaton
    loose: Automaton
    cut: float = 0.0

    def score(self, token: str) -> float:
        """Mean log likelihood ratio of a symbol, best credential against ordinary token."""
        symbols, classes = shape(token), shape(token, 0)
        # a letter of a class is as likely as the class over its number of letters
        widths = sum(WIDTH.get(c, 0.0) for c in classes[:FIXED]) / len(classes)
        ordinary = max(self.plain.score(symbols), self.loose.score(classes) - widths)
        return max(a.score(symbols) for a in self.kinds.values()) - ordinary


def value(text: str, span: Span) -> str:
    """The credential inside a base span."""
    body = text[span[1] : span[2]]
    return ASSIGN.match(body)[2] if span[0] == "assign" else body


def fit(
    docs: DataFrame, sample_docs: int = 4000, sample_tokens: int = 10_000,
    sample_letters: int = 4_000_000, precision: float = 0.99, text: str = "text",
    key: str = "doc_id",
) -> Grammar:
    """Infer the automata.

    Labelled credentials are the base spans found in about ``sample_docs`` documents, chosen by
    a hash, and rule-made ones of public formats; ordinary tokens are the other candidates of
    those documents and rule-made look-alikes. At most ``sample_tokens`` tokens of the documents
    are used, in the order of a hash until they hold ``sample_letters`` letters; what is longer
    than that alone is taken as far. Tokens of any length are learned from, an automaton's tree
    being bounded (``infer``). A third of all is held out and gives the lowest cut that reaches
    ``precision``, from whole tokens.
    """
    ship(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull()).select(key, text)
    share = min(1.0, sample_docs / max(1, rows.count()))
    spread = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                base = base_spans(t)
                cover = Cover(base)
                out += [(span[0], value(t, span)) for span in base]
                out += [
                    ("plain", t[s[1] : s[2]]) for s in candidates(t) if not cover.meets(s)
                ]
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array([k for k, _ in out], pa.string()),
                "token": pa.array([t for _, t in out], pa.string()),
            })

    order = (F.xxhash64("token"), F.col("token"), F.col("kind"))
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sample = (
        rows.where(spread < share).mapInArrow(extract, "kind string, token string")
        .distinct().orderBy(*order).limit(sample_tokens)
        .withColumn("before", F.coalesce(F.sum(F.length("token")).over(so_far), F.lit(0)))
        .where(F.col("before") < sample_letters)
        .select("kind", F.substring("token", 1, sample_letters).alias("token")).toArrow()
    )
    labelled = written_credentials()
    for kind, token in zip(sample["kind"].to_pylist(), sample["token"].to_pylist()):
        labelled.setdefault(kind, []).append(token)
    rng = random.Random(5)
    taught: dict[str, list[str]] = {}
    held: list[tuple[str, float]] = []
    for kind in sorted(labelled):
        tokens = sorted(labelled[kind])
        rng.shuffle(tokens)
        third = len(tokens) // 3
        held += [(t, float(kind != "plain")) for t in tokens[:third]]
        taught[kind] = tokens[third:]
    automata = {kind: infer(map(shape, tokens)) for kind, tokens in taught.items()}
    plain = automata.pop("plain")
    grammar = Grammar(automata, plain, infer(shape(t, 0) for t in taught["plain"]))
    scores = np.array([grammar.score(t) for t, _ in held])
    grammar.cut = max(0.0, threshold(scores, np.array([y for _, y in held]), precision))
    return grammar


def find(
    docs: DataFrame, grammar: Grammar, text: str = "text", key: str = "doc_id",
    redact: bool = False,
) -> DataFrame:
    """Secrets in every whole text.

    Gives ``key``, counts and digest of the base spans, ``n_grammar``, all spans as
    ``kind:start:end``, and with ``redact`` also ``redacted``, the text with every span replaced
    by its kind. A candidate that touches a base span is left out. A missing text is an empty
    one with no spans; repeated rows are searched each, a missing key stays missing, other
    columns are left out, and an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def start():
        learned = shared.value

        def work(keys, texts):
            texts = [t or "" for t in texts]
            bases = [base_spans(t) for t in texts]
            every = []
            for t, base in zip(texts, bases):
                cover = Cover(base)
                every.append(in_order(base + [
                    s for s in candidates(t)
                    if not cover.meets(s) and learned.score(t[s[1] : s[2]]) >= learned.cut
                ], KINDS))
            return {
                key: keys,
                **{f"n_{k}": [sum(s[0] == k for s in base) for base in bases] for k in KINDS[:3]},
                "base_sha256": [digest(base) for base in bases],
                "spans": [as_string(spans) for spans in every],
                "n_grammar": [sum(s[0] == "grammar" for s in spans) for spans in every],
                **({"redacted": [replace(t, s) for t, s in zip(texts, every)]} if redact else {}),
            }

        return work

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(
        docs, [key, text],
        f"{key} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "spans string, n_grammar long" + ", redacted string" * redact, start,
    )
