"""Toxicity by misspelled terms and their context.

A lexicon is learned from labelled documents: words, and beginnings of words with varying ends,
that toxic documents hold and clean ones do not, chosen until they cover the toxic documents
twice. A Levenshtein automaton of every token is intersected with the trie of the lexicon, so
misspelled terms are found too; forms that clean documents hold are words of their own. What stands
around a term says whether it is quoted or meant, and a logistic model turns the terms of a text
into a score.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, functions as F

from trialspark.llm.common import WordCache, map_batches, settle

# Letters and digits, also with signs that stand in for letters.
TOKEN = re.compile(r"[^\W_]+(?:[@$*!|'’]+[^\W_]+)*")
WINDOW = 6  # tokens to either side of a term
# A quotation: an opening mark before a word, and at most so many code points later in its line a
# closing one behind a word.
QUOTED_POINTS = 120
OPENING, CLOSING = re.escape("\"“„«‹‘'`"), re.escape("\"”“»›’'`")
QUOTATION = re.compile(
    rf"(?:^|(?<=[\s(\[]))[{OPENING}](?=\w)[^\n]{{0,{QUOTED_POINTS}}}?(?<=[\w.,!?])[{CLOSING}](?!\w)", re.M
)
# Log-odds of meaning the term, before anything is learned; words that report it,
# and words that address someone.
MEANT, QUOTED, REPORTED, ADDRESSED = 2.0, -3.0, -1.5, 0.5
REPORTING = frozenset(
    "word words term terms called calling quote quoted quotes said says wrote insult insults slur "
    "wort worte begriff sagte zitat mot mots terme dit palabra palabras término dijo cita".split()
)
ADDRESS = frozenset("you your you're du dein dich ihr tu tes vous votre tú eres usted".split())
# Share of a term's strength that is left after so many edits.
STRENGTH = (1.0, 0.7, 0.5)
STEM_LENGTHS = range(3, 9)
# Odd factors that turn one 32-bit hash into several.
TURNS = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393, 2860486313], np.uint32)


def edits_allowed(term: str, stem: bool) -> int:
    """Edits that leave a term recognisable."""
    if stem:
        return int(len(term) >= 6)
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


@dataclass(frozen=True)
class Term:
    """A word, or the beginning of words (``stem``), and the edits that it allows."""

    text: str
    stem: bool = False
    edits: int = -1

    def __post_init__(self):
        if self.edits < 0:
            object.__setattr__(self, "edits", edits_allowed(self.text, self.stem))


class Node:
    """Trie node: children by letter, terms that end here, and the most edits of any term below."""

    __slots__ = ("children", "ends", "edits")

    def __init__(self):
        self.children: dict[str, Node] = {}
        self.ends: list[tuple[int, Term]] = []
        self.edits = 0


class Lexicon:
    """Terms in a trie, and the tokens that come near one."""

    def __init__(self, terms: Sequence[Term], exempt: Iterable[str] = ()):
        self.terms, self.exempt, self.root = list(terms), frozenset(exempt), Node()
        for i, term in enumerate(self.terms):
            node = self.root
            for letter in term.text:
                node.edits = max(node.edits, term.edits)
                node = node.children.setdefault(letter, Node())
            node.edits = max(node.edits, term.edits)
            node.ends.append((i, term))
        # A token that no later letter can change: longer ones are cut behind it.
        self.reach = max((len(t.text) + t.edits + 1 for t in self.terms), default=0)
        self.sieves = [self._sieve(n) for n in range(self.reach + 1)]

    def _sieve(self, length: int) -> Callable:
        """Whether a token of this length can be near a term.

        Of ``edits + 1`` pieces of a term one stays whole, and moves by ``edits`` places at most.
        """
        ways = []
        for t in self.terms:
            if not t.stem and abs(len(t.text) - length) > t.edits:
                continue
            cuts = [round(i * len(t.text) / (t.edits + 1)) for i in range(t.edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                low, high = max(0, a - t.edits), a + t.edits
                ways.append(f".{{{low},{high}}}" * (high > 0) + re.escape(t.text[a:b]))
        return re.compile("(?s)" + "|".join(dict.fromkeys(ways))).match if ways else lambda token: None

    def nearest(self, token: str) -> tuple[int, int]:
        """Least edits and the term for a token in lower case; (-1, -1) if none is near.

        The automaton of the token is run along the trie: after some letters of a term, bit i of
        state e says that the first i letters of the token match them with e edits.
        """
        if len(token) >= self.reach:
            token = token[: self.reach]
        if not self.sieves[len(token)](token):
            return -1, -1
        size = len(token)
        at: dict[str, int] = defaultdict(int)
        for i, letter in enumerate(token):
            at[letter] |= 1 << i
        within = (1 << (size + 1)) - 1
        start = tuple((1 << (e + 1)) - 1 & within for e in range(self.root.edits + 1))
        best = (len(STRENGTH), -1)
        stack = [(self.root, start)]
        while stack:
            node, states = stack.pop()
            for i, term in node.ends:
                for e in range(term.edits + 1):
                    if states[e] if term.stem else states[e] >> size & 1:
                        best = min(best, (e, i))
                        break
            for letter, child in node.children.items():
                mask, new = at.get(letter, 0), []
                for e in range(child.edits + 1):
                    state = (states[e] & mask) << 1
                    if e:
                        state |= states[e - 1] | states[e - 1] << 1 | new[e - 1] << 1
                    new.append(state & within)
                if any(new):
                    stack.append((child, tuple(new)))
        return best if best[1] >= 0 else (-1, -1)


@dataclass
class Model:
    """``around``: log-odds of words in the window; ``weights``: of ``features``, constant first."""

    terms: list[Term] = field(default_factory=list)
    exempt: frozenset[str] = frozenset()
    around: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = ()


@dataclass(frozen=True)
class Hit:
    term: int
    edits: int
    start: int
    end: int
    meant: float


class Finder:
    """Terms of texts, each with the probability that it is meant."""

    def __init__(self, model: Model):
        self.model = model
        self.lexicon = Lexicon(model.terms, model.exempt)
        self.known = WordCache(self._look)

    def _look(self, token: str) -> tuple[int, int]:
        word = token.lower()
        edits, term = self.lexicon.nearest(word)
        if edits > 0 and word in self.lexicon.exempt:
            return -1, -1
        return edits, term

    def tokens(self, text: str) -> set[str]:
        """Different tokens that are near a term."""
        return {t for t in set(TOKEN.findall(text)) if self.known[t][1] >= 0}

    def hits(self, text: str) -> list[Hit]:
        near = self.tokens(text)
        if not near:
            return []
        found, places = [], list(TOKEN.finditer(text))
        quotations = [m.span() for m in QUOTATION.finditer(text)]
        for i, place in enumerate(places):
            if place.group() in near:
                edits, term = self.known[place.group()]
                at = bisect.bisect(quotations, place.span()) - 1
                quoted = at >= 0 and place.end() <= quotations[at][1]
                found.append(Hit(term, edits, *place.span(), self.meant(places, i, quoted)))
        return found

    def window(self, places: list[re.Match], i: int) -> set[str]:
        near = places[max(0, i - WINDOW) : i] + places[i + 1 : i + 1 + WINDOW]
        return {p.group().lower() for p in near if len(p.group()) <= 32}

    def meant(self, places: list[re.Match], i: int, quoted: bool) -> float:
        """Probability that a term is meant and not only quoted."""
        words = self.window(places, i)
        odds = MEANT + QUOTED * quoted
        odds += REPORTED * bool(words & REPORTING) + ADDRESSED * bool(words & ADDRESS)
        odds += sum(self.model.around.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def features(hits: Sequence[Hit]) -> list[float]:
    """Of a text: exact terms, misspelled ones, different ones, and the surest one."""
    exact = sum(h.meant for h in hits if not h.edits)
    near = sum(STRENGTH[h.edits] * h.meant for h in hits if h.edits)
    sure: dict[int, float] = {}
    for h in hits:
        sure[h.term] = max(sure.get(h.term, 0.0), STRENGTH[h.edits] * h.meant)
    return [math.log1p(exact), math.log1p(near), math.log1p(sum(sure.values())), max(sure.values(), default=0.0)]


# Means of the weights' prior: without data a meant term is probably toxic, a quoted one is not.
PRIOR = np.array([-3.0, 1.0, 1.0, 1.0, 2.5])
PRECISION = 0.3


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Most probable weights under the prior, by Newton steps with halving."""
    x = np.hstack([np.ones((len(x), 1)), x])
    weights = PRIOR.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + PRECISION / 2 * ((w - PRIOR) ** 2).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -40, 40)))
        slope = x.T @ (p - y) + PRECISION * (weights - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + PRECISION * np.eye(len(weights))
        step, now = np.linalg.solve(curve, slope), loss(weights)
        while loss(weights - step) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        weights = weights - step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def probability(weights: Sequence[float], x: Sequence[float]) -> float:
    z = weights[0] + sum(w * v for w, v in zip(weights[1:], x))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, sample_docs: int, text: str, key: str
) -> DataFrame:
    """Texts, words and labels of at most ``sample_docs`` documents per label, copies set aside.

    The words are those outside quotations, since a quoted term is no sign of anything.
    A document has the largest label of its rows. The ids are drawn first, by a hash, and sent to
    the texts, which stay where they are. A document that shares one of its least hashes of three
    words in a row with an earlier one, as near copies do, is left out.
    """
    known = labels.where(f"`{key}` is not null and toxic is not null").groupBy(
        F.col(f"`{key}`").alias("id")
    ).agg((F.max("toxic") > 0).alias("toxic"))
    drawn = [
        known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(sample_docs)
        for label in (False, True)
    ]
    ids = settle(drawn[0].union(drawn[1]))
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).where("text <> ''")
    # At most twice sample_docs ids.
    rows = texts.join(F.broadcast(ids), "id")

    def start():
        def work(ids, texts, labels):
            out = {"id": ids, "text": texts, "toxic": labels, "words": [], "least": [], "mark": []}
            for t in texts:
                words = [w.lower() for w in TOKEN.findall(QUOTATION.sub(" ", t))]
                runs = set(map("\n".join, zip(words, words[1:], words[2:]))) or {t}
                hashed = np.fromiter((zlib.crc32(r.encode()) for r in runs), np.uint32, len(runs))
                out["least"].append([int((hashed * turn).min()) for turn in TURNS])
                out["words"].append(sorted(set(words)))
                out["mark"].append(zlib.crc32(t.encode()))
            return out

        return work

    kind = docs.schema[key].dataType.simpleString()
    split = settle(map_batches(
        rows, ["id", "text", "toxic"],
        f"id {kind}, text string, toxic boolean, words array<string>, least array<long>, mark long", start,
    ).dropDuplicates(["id", "mark"]))
    own = F.struct("id", "mark")
    shared = split.select("toxic", own.alias("own"), F.posexplode("least").alias("turn", "value"))
    first = shared.groupBy("toxic", "turn", "value").agg(F.min("own").alias("first"), F.collect_list("own").alias("all"))
    later = first.select(F.explode("all").alias("own"), "first").where("own <> first").select("own.*").distinct()
    return settle(split.join(later, ["id", "mark"], "left_anti").select("toxic", "id", "text", "words"))


def candidates(sample: DataFrame, least_docs: int, least_odds: float, most: int) -> list[tuple[Term, float]]:
    """Words and stems that speak for toxicity, with their evidence, the strongest first.

    The evidence bounds the chance (as minus its logarithm) that so many of the documents with a
    term are toxic although it says nothing. It must make up for the number of words and stems
    that are looked at, so that at most about one is there by chance.
    """
    pairs = sample.select("toxic", "id", F.explode("words").alias("word"))
    words = settle(pairs.groupBy("word").agg(
        F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good")
    ))
    totals = sample.agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good")).first()
    if not totals.bad or not totals.good:
        return []
    starts = F.explode(F.transform(
        F.filter(F.array(*map(F.lit, STEM_LENGTHS)), lambda n: n < F.length("word")),
        lambda n: F.substring("word", F.lit(1), n),
    )).alias("text")
    # Clean documents of a stem are counted once per word, toxic ones once. No word may be all of it.
    clean = words.select(starts, "bad", "good").groupBy("text").agg(
        F.sum("good").alias("good"), F.max("bad").alias("largest"), F.count_if(F.col("bad") > 0).alias("ends")
    ).where("ends >= 3")
    toxic = pairs.where("toxic").select("id", starts).distinct().groupBy("text").agg(F.count("*").alias("bad"))
    stems = clean.join(toxic, "text").where("largest <= 0.8 * bad").select(
        "text", F.lit(True).alias("stem"), "bad", "good"
    )
    both = words.select(F.col("word").alias("text"), F.lit(False).alias("stem"), "bad", "good").union(stems)
    seen = settle(both.where(F.col("bad") + F.col("good") >= least_docs))
    looked_at = seen.count()
    bad, good = F.col("bad"), F.col("good")
    usual = totals.bad / (totals.bad + totals.good)
    evidence = bad * F.ln(bad / ((bad + good) * usual)) + F.when(
        good > 0, good * F.ln(good / ((bad + good) * (1 - usual)))
    ).otherwise(0.0)
    odds = F.ln((bad + 0.5) / (totals.bad + 1)) - F.ln((good + 0.5) / (totals.good + 1))
    kept = seen.where(bad >= least_docs).select("*", evidence.alias("evidence")).where(
        (odds >= least_odds) & (F.col("evidence") >= math.log(max(looked_at, 1)))
    )
    rows = kept.orderBy(F.desc("evidence"), "stem", F.desc(F.length("text")), "text").limit(most)
    return [(Term(r.text, r.stem), r.evidence) for r in rows.collect()]


def _nested(a: Term, b: Term) -> bool:
    """Whether a stem begins the other term."""
    return a.stem and b.text.startswith(a.text) or b.stem and a.text.startswith(b.text)


def cover(
    found: Sequence[tuple[Term, float]], docs: Sequence[Sequence[int]], times: int, least: int,
    sure: float,
) -> list[Term]:
    """Candidates that cover documents ``times`` times each, the one with most evidence first.

    ``docs`` lists the candidates of each document. A candidate counts by its evidence in the
    documents that are not yet covered often enough, and must add ``least`` of them.
    """
    members: dict[int, list[int]] = defaultdict(list)
    for d, own in enumerate(docs):
        for c in own:
            members[c].append(d)
    short, chosen = [times] * len(docs), []
    gain = {c: len(own) for c, own in members.items()}
    while gain:
        best = max(gain, key=lambda c: (gain[c] * found[c][1] / len(members[c]), -c))
        if gain[best] < least:
            gain.pop(best)
            continue
        chosen.append(found[best][0])
        for c in [c for c in gain if c == best or _nested(found[c][0], found[best][0])]:
            gain.pop(c)
        for d in members[best]:
            if short[d]:
                short[d] -= 1
                if not short[d]:
                    for c in docs[d]:
                        if c in gain:
                            gain[c] -= 1
    for term, evidence in found:
        if evidence >= sure and not any(term == t or _nested(term, t) for t in chosen):
            chosen.append(term)
    return chosen


def fit(
    docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, least_docs: int = 3,
    least_odds: float = 3.0, most_terms: int = 2000, text: str = "text", key: str = "doc_id",
) -> Model:
    """Lexicon, exempt forms, context and weights, from labelled documents.

    ``labels`` has ``key`` and ``toxic``; missing ones teach nothing. Learned from at most
    ``sample_docs`` documents per label, which bounds what the driver holds; the lexicon is chosen
    among the ``most_terms`` strongest candidates. Without a toxic and a clean document the lexicon
    is empty and all scores are alike.
    """
    sample = labelled_sample(docs, labels, sample_docs, text, key)
    found = candidates(sample, least_docs, least_odds, most_terms)
    if not found:
        return Model(weights=tuple(PRIOR))
    words = {t.text: i for i, (t, _) in enumerate(found) if not t.stem}
    stems = {t.text: i for i, (t, _) in enumerate(found) if t.stem}

    def holding():
        def work(rows):
            out = []
            for row in rows:
                own = {words[w] for w in row if w in words}
                own |= {stems[w[:n]] for w in row for n in STEM_LENGTHS if n < len(w) and w[:n] in stems}
                out.append(sorted(own))
            return {"own": out}

        return work

    held = map_batches(sample.where("toxic"), ["words"], "own array<int>", holding)
    rows = [r.own for r in held.collect()]
    least = max(least_docs, len(rows) // 100)
    terms = cover(found, rows, times=2, least=least, sure=1.2 * min(e for _, e in found))
    model = _with_exempt(sample, terms)
    model.around = _around(sample, model)

    def measuring():
        finder = Finder(model)
        return lambda texts, labels: {"x": [features(finder.hits(t)) for t in texts], "y": labels}

    measured = map_batches(sample, ["text", "toxic"], "x array<double>, y boolean", measuring).collect()
    x, y = np.array([r.x for r in measured]), np.array([float(r.y) for r in measured])
    model.weights = tuple(logistic(x, y))
    return model


def _with_exempt(sample: DataFrame, terms: Sequence[Term], crowd: int = 3) -> Model:
    """The terms, and the forms near them that clean documents hold: words of their own.

    A term with ``crowd`` such forms lies among ordinary words and allows no edits.
    """

    def start():
        lexicon = Lexicon(terms)
        known = WordCache(lexicon.nearest)
        return lambda rows: {"near": [
            [{"form": w, "term": known[w][1]} for w in row if known[w][0] > 0] for row in rows
        ]}

    clean = map_batches(
        sample.where("not toxic"), ["words"], "near array<struct<form: string, term: int>>", start
    )
    rows = clean.select(F.inline("near")).distinct().collect()
    crowded = {i for i, n in Counter(r.term for r in rows).items() if n >= crowd}
    return Model(
        terms=[replace(t, edits=0) if i in crowded else t for i, t in enumerate(terms)],
        exempt=frozenset(r.form for r in rows),
    )


def _around(sample: DataFrame, model: Model, least: int = 3) -> dict[str, float]:
    """Log-odds of words around terms in toxic documents against those around terms in clean ones."""

    def start():
        finder = Finder(model)

        def work(texts, labels):
            rows = []
            for t in texts:
                near = finder.tokens(t)
                places = list(TOKEN.finditer(t)) if near else []
                counted = Counter(
                    w for i, p in enumerate(places) if p.group() in near for w in finder.window(places, i)
                )
                rows.append([{"word": w, "n": n} for w, n in counted.items()])
            return {"rows": rows, "toxic": labels}

        return work

    seen = map_batches(
        sample, ["text", "toxic"], "rows array<struct<word: string, n: long>>, toxic boolean", start
    ).select("toxic", F.inline("rows"))
    counted = settle(seen.groupBy("word").agg(
        F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("bad"),
        F.coalesce(F.sum(F.when(~F.col("toxic"), F.col("n"))), F.lit(0)).alias("good"),
    ))
    bad, good = counted.agg(F.sum("bad"), F.sum("good")).first()
    if not bad or not good:
        return {}
    odds = F.ln((F.col("bad") + 1) / (bad + 2.0)) - F.ln((F.col("good") + 1) / (good + 2.0))
    # Few sightings say little, and a clean one is needed to tell the two apart.
    shrunk = odds * (F.col("bad") + F.col("good")) / (F.col("bad") + F.col("good") + 20)
    rows = counted.where(F.col("good") >= least).select("word", shrunk.alias("odds")).where(F.abs("odds") > 0.3)
    return {r.word: r.odds for r in rows.orderBy(F.desc(F.abs("odds")), "word").limit(2000).collect()}


def score(
    docs: DataFrame, model: Model, cut: float = 0.3, text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """``key``, ``score`` (0 to 1), ``predicted`` (1 if the score reaches ``cut``) and ``hits``.

    ``hits`` holds the terms found in the whole text: ``term``, ``start`` and ``end`` in code
    points, ``edits``, and ``meant``, the probability that it is not only quoted. A missing text
    counts as an empty one, which has the score of a text without hits. Repeated rows are scored
    each, a missing key stays missing, other columns are left out, and an empty table gives an
    empty one.
    """
    weights = model.weights or tuple(PRIOR)
    names = [t.text + "*" * t.stem for t in model.terms]

    def start():
        finder = Finder(model)

        def work(keys, texts):
            scores, lists = [], []
            for t in texts:
                hits = finder.hits(t) if t else []
                scores.append(probability(weights, features(hits)))
                lists.append([
                    {"term": names[h.term], "start": h.start, "end": h.end, "edits": h.edits, "meant": h.meant}
                    for h in hits
                ])
            return {
                "own": keys, "score": scores, "predicted": [int(s >= cut) for s in scores], "hits": lists,
            }

        return work

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(
        docs.select(F.col(f"`{key}`").alias("own"), F.col(f"`{text}`").alias("text")), ["own", "text"],
        f"own {kind}, score double, predicted int, "
        "hits array<struct<term: string, start: long, end: long, edits: int, meant: double>>",
        start,
    ).withColumnRenamed("own", key)
