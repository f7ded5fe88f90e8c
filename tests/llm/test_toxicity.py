"""Toxicity: the automaton against plain edit distance, context, and planted documents."""

import random

from trialspark.llm import queries
from trialspark.llm.toxicity import QUOTATION, Finder, Lexicon, Model, Term, fit, score


def distance(a, b, beginning=False):
    """Edits between a term and a token, or the token's best beginning."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) if beginning else row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(3)
    terms = [Term(t) for t in ("loser", "pathetic", "scum", "worthless", "clown", "abcabcab")]
    terms += [Term("lowei", True), Term("lostra", True)]
    lexicon = Lexicon(terms)
    tokens = [""]
    for t in terms:
        for _ in range(400):
            letters = list(t.text) + list(rng.choice(["", "", "x", "chaft", "s" * 40]))
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(letters))
                kind = rng.randint(0, 2)
                if kind == 0:
                    letters.insert(at, rng.choice("abcelorstw"))
                elif letters and at < len(letters):
                    if kind == 1:
                        del letters[at]
                    else:
                        letters[at] = rng.choice("abcelorstw")
            tokens.append("".join(letters))
    near = 0
    for token in tokens:
        ways = [(distance(t.text, token, t.stem), i) for i, t in enumerate(terms)]
        ways = [w for w in ways if w[0] <= terms[w[1]].edits]
        assert lexicon.nearest(token) == (min(ways) if ways else (-1, -1)), token
        near += bool(ways)
    assert near > 1000


def test_quotation():
    def is_quoted(text, word="idiot"):
        return any(word in m.group() for m in QUOTATION.finditer(text))

    assert is_quoted('They called him "an idiot" twice') and is_quoted("das Wort „idiot“ fiel")
    assert is_quoted("he said 'idiot', and left") and is_quoted("« idiot »".replace("« ", "«").replace(" »", "»"))
    assert not is_quoted("you idiot") and not is_quoted('he said "hello" to the idiot and "bye"')
    assert not is_quoted("don't be an idiot, it's bad") and not is_quoted('"hi"\nidiot\n"ho"')


FILLER = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me") for b in ("rin", "tal", "ven", "sop", "gar", "hul")]
BAD = ["loser", "pathetic", "worthless", "clown"]


def documents(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(FILLER) for _ in range(rng.randint(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(BAD))
        elif i % 5 == 1:
            words.insert(3, f'the word "{rng.choice(BAD)}" is')
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def misspelled(word, rng):
    at = rng.randint(1, len(word) - 2)
    return word[:at] + rng.choice("qzx") + word[at + 1 :]


def test_misspelled_terms_are_caught_and_quoted_ones_left_alone(spark):
    rows = documents(600, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), sample_docs=300)
    assert {t.text for t in model.terms if not t.stem} >= set(BAD)
    rng = random.Random(9)
    new = []
    for i, text, toxic in documents(300, 2):
        for word in BAD:
            if toxic:
                text = text.replace(word, misspelled(word, rng))
        new.append((i, text, toxic))
    table = spark.createDataFrame(new, "doc_id long, text string, toxic int")
    scored = {r.doc_id: r for r in score(table, model).collect()}
    bad = [scored[i].predicted for i, _, toxic in new if toxic]
    assert sum(bad) >= 0.85 * len(bad)
    said = [scored[i] for i, _, toxic in new if i % 5 == 1]
    assert sum(r.predicted for r in said) <= 0.1 * len(said)
    assert all(r.hits for r in said)
    clean = [scored[i].predicted for i, _, _ in new if i % 5 > 1]
    assert not any(clean)
    hit = next(h for i, t, x in new if x for h in scored[i].hits)
    assert hit.edits > 0


def test_clean_forms_are_words_of_their_own():
    model = Model(terms=[Term("moron")], exempt=frozenset({"oron"}), weights=(-3.0, 1.0, 1.0, 1.0, 2.0))
    finder = Finder(model)
    text = "oron Moron m0ron moronic"
    assert [(text[h.start : h.end], h.edits) for h in finder.hits(text)] == [("Moron", 0), ("m0ron", 1)]


def test_odd_rows(spark):
    rows = documents(200, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    model = fit(docs.select("doc_id", "text"), labels)
    odd = spark.createDataFrame(
        [(None, "you loser, worthless clown", 9.0), (1, None, 1.0), (1, "", 1.0), (2, "x" * 200_000, 1.0),
         (2, "loser " * 20_000, 1.0), (2, "loser " * 20_000, 1.0), (3, "1 2 3 \n\t", 0.0)],
        "doc_id long, text string, score double",
    )
    found = score(odd, model).collect()
    assert len(found) == 7 and all(0 <= r.score <= 1 for r in found)
    by = lambda k: [(r.predicted, len(r.hits)) for r in found if r.doc_id == k]
    assert by(None) == [(1, 3)] and by(1) == [(0, 0)] * 2 and by(3) == [(0, 0)]
    assert sorted(by(2)) == [(0, 0), (1, 20_000), (1, 20_000)]
    assert score(odd.limit(0), model).collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit(docs, none)
    assert not model.terms
    assert score(docs, model).first().predicted == 0


def test_held_out_documents(spark):
    """The whole query: held-out labels of a benchmark table."""
    sf_dir = "/root/testdata/sf0.1"
    found = queries.op11_toxicity(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    bad = [r.predicted for r in rows if r.toxic]
    good = [r.predicted for r in rows if not r.toxic]
    assert sum(bad) >= 0.85 * len(bad) and sum(good) <= 0.02 * len(good)
    assert found.count() == queries.documents(spark, sf_dir).count()
