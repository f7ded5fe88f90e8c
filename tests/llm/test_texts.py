"""Counting, encoding, language, personal data, secrets, lines and packing on awkward tables."""

import base64
import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trialspark.llm import langid, linededup, packing, pieces, pii, secretscan, tokens
from trialspark.llm.queries import held_out, vocabulary

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SCHEMA = "doc_id long, text string, lang string, score string, pos int, side int"
LONG = "wordy text of one line " * 20_000 + "x" * 300_000
TEXTS = [
    None, "", " ", "\n\n\n", "a", "A b", "<|endoftext|> and <s> </s>", "don't  stop\t\n now", "ß É é İ Σας",
    "中文 текст ١٢ ½   \x1c \x85", "▁▁a ▁ b", "   lead", LONG, "a", "a",
]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, None, "s", 1, 2) for k, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, [*enumerate(TEXTS), (None, "keyless"), (3, "\n\n\n"), (3, "other")])


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_token_counts(awkward, empty):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = tokens.count_tokens(awkward, path, limit=4)
    expected = []
    for r in awkward.collect():
        text = r.text or ""
        ids = library.encode(text, add_special_tokens=False).ids
        n = len(ids)
        cut = len(text.encode()) if n <= 4 else None
        expected.append((r.doc_id, len(text.encode()), n, n > 4, cut))
    got = as_rows(found, "doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes")
    assert [r[:4] for r in got] == [r[:4] for r in sorted(expected, key=str)]
    assert all(g[4] == e[4] for g, e in zip(got, sorted(expected, key=str)) if e[4] is not None)
    assert tokens.count_tokens(empty, path).collect() == []


def test_prefix_counts_match_the_library():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, tool = Tokenizer.from_file(path), tokens.counter(path)
    for word in ("internationalization", "aaaaaaaaaaaa", "thntstou", " hello", "xyzzy123"):
        counts = tool.prefix_counts(word)
        for i in range(len(word) + 1):
            if len(tool.pieces(word[:i])) <= 1:
                assert counts[i] == len(library.encode(word[:i], add_special_tokens=False).ids)
    text = "the quick brown foxes"
    ids = library.encode(text, add_special_tokens=False)
    assert [tool.cut(text, n) for n in range(len(ids.ids))] == [0, *(b for _, b in ids.offsets)][:-1]
    assert tokens.bytes_within([0, 1, 2, 1, 2], 1) == 3


def test_random_texts_encode_as_the_libraries_do():
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(3)
    letters = [*map(chr, range(32, 127)), *"\n\t\r éüßÄ中文Ωώ́ΣİІ😀٣½²ª\x85\xa0\x1c▁", "the", " of", "    ", "'ll", "<s>"]
    words = packing.encoder(vocabulary("word_bpe_49k.json"))
    table = pieces.piece_table(vocabulary("piece_bpe_32k.model"))
    counter = tokens.counter(vocabulary("byte_bpe_50k.json"))
    byte = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert isinstance(table.library, sentencepiece.SentencePieceProcessor)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        ids = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert words.encode(text) == np.array(ids, "<u4").tobytes()
        ids = table.library.encode(text, add_bos=True, add_eos=True)
        assert table.encode(text) == np.array(ids, "<u4").tobytes()
        assert counter.count(text) == len(byte.encode(text, add_special_tokens=False).ids)


def test_pieces(awkward, empty):
    path = vocabulary("piece_bpe_32k.model")
    library = pieces.piece_table(path).library
    expected = []
    for r in awkward.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        decoded = library.decode(ids)
        expected.append((
            r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest(),
        ))
    found = pieces.round_trip(awkward, path)
    assert as_rows(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=str)
    back = pieces.decode(pieces.encode(awkward, path), path)
    plain = [(r.doc_id, (r.text or "").replace("▁", " ")) for r in awkward.collect()]
    assert as_rows(back, "doc_id", "text") == sorted(plain, key=str)
    assert pieces.round_trip(empty, path).collect() == []


def test_language(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~held_out()), rows_per_language=100)
    found = docs.join(langid.predict(docs, model), "doc_id").where(held_out())
    right, every = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.98 * every
    odd = {(r.doc_id, r.lang_pred, r.score > 0) for r in langid.predict(awkward, model).collect()}
    assert {(0, "und", False), (1, "und", False), (2, "und", False), (3, "und", False)} <= odd
    assert all(0 <= r.score <= 1 for r in langid.predict(awkward, model).collect())
    nothing = langid.fit(empty)
    assert nothing.languages == ()
    assert {r.lang_pred for r in langid.predict(awkward, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).collect() == []
    labelled = langid.label(awkward, model)  # a column named score is there already
    assert labelled.columns == ["doc_id", "text", "lang", "pos", "side", "lang_pred", "score"]
    assert labelled.count() == awkward.count()


def test_blocks_of_a_long_text_count_each_letter_once(monkeypatch):
    text = "Der lange Text, " * 50
    whole = langid.bucket_counts([text, "", "kurz"])
    monkeypatch.setattr(langid, "CELLS", 37)
    assert (langid.bucket_counts([text, "", "kurz"]) == whole).all()


def test_personal_data(awkward, empty):
    selector = pii.fit(awkward)
    found = {r.doc_id: r for r in pii.find(awkward, selector, redact=True).collect()}
    assert found[12].spans == "" and found[12].redacted == LONG and found[0].redacted == ""
    assert pii.find(empty, selector).collect() == []
    assert pii.fit(empty).cuts.keys() == set(pii.KINDS)
    text = "Write ann@x.example.com, call (555) 123-4567 or +1 (743) 555-3824, card 4111 1111 1111 1111, 10.0.0.300"
    ((base, every),) = pii.select([text], selector)
    assert [text[a:b] for _, a, b in base] == ["ann@x.example.com", "+1 (743) 555-3824", "4111 1111 1111 1111"]
    assert ("phone", text.index("(555)"), text.index(" or +1")) in every
    changed = pii.redact(awkward, selector)
    assert changed.count() == awkward.count() and "side" in changed.columns


def test_loose_formats_are_found_where_they_are_common(spark):
    """Loose phones in the corpus do not raise the cuts until none is selected."""
    rng = random.Random(8)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    loose = [f"({number(3)}) {number(3)}-{number(4)}" for _ in range(3000)]
    rows = [(i, f"please call {p} for the tour today") for i, p in enumerate(loose)]
    rows += [(3000 + i, f"please call +49 30 {number(4)} {number(4)} or order {number(3)}-{number(3)}-{number(4)} now") for i in range(300)]
    docs = frame(spark, rows)
    selector = pii.fit(docs)
    assert all(cut <= 1 for cut in selector.cuts.values())
    found = {r.doc_id: r.spans for r in pii.find(docs, selector).collect()}
    assert sum(found[i] == f"phone:12:{12 + len(p)}" for i, p in enumerate(loose)) >= 2700
    text = "mail joe@site.org or call +49 30 1234 5678; we sent the order 123-456-7890 and tel 212 555 0199"
    assert pii.corpus_examples(text)[1].count(1.0) == 2
    assert pii.corpus_examples(text)[1].count(0.0) == 1


def test_selection_is_learned_from_every_text(spark):
    """More texts than a sample of thousands, and few or many examples give the same trees."""
    rows = [(i, f"please call +49 {i % 97:02} {i:04} {i * 7 % 9973:04} for the tour today") for i in range(9000)]
    rows += [(9000 + i, f"your order {i:03}-123-4567 is on its way") for i in range(400)] + [(None, None)]
    docs = frame(spark, rows)
    right = wrong = 0
    for _, text in rows[:-1]:
        if zlib.crc32(text.encode()) % 3:
            labels = pii.corpus_examples(text)[1]
            right, wrong = right + labels.count(1.0), wrong + labels.count(0.0)
    made = pii.written_examples()[1][np.random.default_rng(3).permutation(len(pii.written_examples()[1])) % 3 != 0]
    share = (right + made.sum()) / (right + wrong + len(made))
    here, there = pii.fit(docs, trees=2), pii.fit(docs, trees=2, most_local=100)
    assert right > 5000 and abs(here.model.start - np.log(share / (1 - share))) < 1e-9
    assert here.cuts == there.cuts and abs(here.model.slope - there.model.slope) < 1e-6
    for a, b in zip(here.model.grown, there.model.grown, strict=True):
        assert all(np.array_equal(u, v) for u, v in zip(a, b, strict=True))


def plain_personal(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for kind, rule, few, many in (
        ("card", r"[0-9]([\x20-]?[0-9])+", 12, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15),
    ):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1]))
            if few <= len(digits) <= many and (kind == "phone" or total % 10 == 0):
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def plain_secrets(text):
    rule = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [("assign", *m.span()) for m in re.finditer(rule, text, re.A) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], secretscan.KINDS.index(s[0])))


def test_loose_addresses_are_proposed_whole():
    """Parts of any length; a long name is proposed from where it starts."""
    name, domain = "a.b" * 60, "sub-domain" * 12
    for text in (f"{name} [at] {domain} (dot) example.org", f"{name} at {domain} dot {'x dot ' * 9}org",
                 f"{name}(at){'p.' * 20}org"):
        assert ("email", 4, 4 + len(text)) in pii.candidates(f"see {text} now")
    start = time.perf_counter()
    assert pii.candidates("a." * 200_000 + " at " + "b" * 200_000 + " [at] ") == []
    assert time.perf_counter() - start < 5


def test_base_rules_against_plain_ones():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1234567890.@@+-_ ()%.c\n٣é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_personal(text)
    parts = ["password", "toKen", "API_key", "=", ":", " ", '"', "AKIA", "ABCDEFGH12", "0123456789abcdef", "deadbeef", "G", "x", "\n", "ſ"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secretscan.base_spans(text) == plain_secrets(text)


def test_secrets(awkward, empty):
    grammar = secretscan.fit(awkward)
    found = {r.doc_id: r for r in secretscan.find(awkward, grammar, redact=True).collect()}
    assert found[0].spans == "" and found[4].redacted == "a"
    assert secretscan.find(empty, grammar).collect() == []
    fresh = secretscan.written_credentials(80, seed=77)
    plain = fresh.pop("plain")
    caught = [grammar.score(t) >= grammar.cut for kind in fresh.values() for t in kind]
    assert np.mean(caught) > 0.95
    assert np.mean([grammar.score(t) >= grammar.cut for t in plain]) < 0.05


def test_long_tokens_are_scored(spark, awkward):
    grammar = secretscan.fit(awkward)
    rng = random.Random(3)
    token = "eyJhbG" + "".join(rng.choice("ABCXYZabcxyz0123456789") for _ in range(5000))
    rows = secretscan.find(frame(spark, [(1, f"see {token} here")]), grammar).collect()
    assert rows[0].spans == f"grammar:4:{4 + len(token)}"
    assert secretscan.candidates("a1" * 40_000 + ". " + "B2" * 200) == [
        ("grammar", 0, 80_000), ("grammar", 80_002, 80_402)
    ]


def test_keys_of_one_case_and_joined_tokens(spark, awkward):
    """Keys that no maker of the module wrote: digests in base 32, in either case."""
    grammar = secretscan.fit(awkward)
    keys = [base64.b32encode(hashlib.sha256(str(i).encode()).digest()).decode() for i in range(300)]
    upper = [re.sub("[^A-Z]", "", k)[:28] for k in keys]
    for tokens, least in ((upper, 0.95), ([k.lower() for k in upper], 0.85), (keys, 0.95)):
        assert np.mean([grammar.score(t) >= grammar.cut for t in tokens]) >= least
    words = ("internationalization", "Verantwortungsbereich", "counterrevolutionary", "Anticonstitutionnellement",
             "well-known-international-standards", "RESPONSIBILITIES-AND-OBLIGATIONS")
    assert sum(grammar.score(w) >= grammar.cut for w in words) <= 1
    signed = ".".join(base64.urlsafe_b64encode(hashlib.sha512(bytes([i])).digest()).decode().rstrip("=") for i in range(3))
    assert secretscan.candidates(f"see {signed}. Then") == [("grammar", 4, 4 + len(signed))]
    assert secretscan.candidates("xz" * 7 + "." + "yz" * 8) == [("grammar", 15, 31)]
    assert secretscan.candidates("=" * 300 + " " + "x" * 300) == []


def test_long_ordinary_tokens_are_learned_whole(spark):
    """A corpus whose ordinary tokens are long teaches them; the letters of the sample are bounded."""
    rng = random.Random(4)
    paths = ["/".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(400)) for _ in range(60)]
    docs = frame(spark, [(i, f"see {p} there") for i, p in enumerate(paths)])
    grammar = secretscan.fit(docs)
    assert sum(r.n_grammar for r in secretscan.find(docs, grammar).collect()) == 0
    assert secretscan.fit(docs, sample_letters=100).cut >= 0
    tree = secretscan.infer(map(secretscan.shape, paths), states=50)
    assert len(tree.step) <= 50


def test_inference_merges_a_loop():
    automaton = secretscan.infer(["ab" * n + secretscan.END for n in range(1, 40)])
    assert len(automaton.step) < 10
    assert automaton.score("ab" * 60) > automaton.score("ba" * 60)


def plain_lines(rows):
    """(key, text, lines, removed); rows without repeated keys."""
    first, out = {}, []
    for k, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0])):
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            run = tuple(lines[p : p + 3])
            if all(not x.strip(" \t\r") for x in run):
                continue
            if first.setdefault(run, (k, p)) != (k, p):
                gone |= {p, p + 1, p + 2}
        out.append((k, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return out + [(k, None, 0, 0) for k, t in rows if t is None]


def test_lines(spark, awkward, empty):
    rng = random.Random(1)
    rows = [(k, "\n".join(rng.choice("abc ") for _ in range(rng.randint(1, 12)))) for k in range(60)]
    rows += [(60, None), (61, ""), (None, "q\nr\ns\nq\nr\ns"), (62, "q\nr\ns"), (63, "\n" * 9)]
    found = linededup.drop_repeated_runs(frame(spark, rows))
    assert as_rows(found, "doc_id", "text", "n_lines", "n_removed") == sorted(plain_lines(rows), key=str)
    assert set(frame(spark, rows).columns) < set(found.columns)
    twice = linededup.drop_repeated_runs(frame(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")]))
    assert as_rows(twice, "doc_id", "text") == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "d")]
    assert linededup.drop_repeated_runs(awkward).count() == awkward.count()
    assert linededup.drop_repeated_runs(empty).collect() == []
    many = "\n".join(f"line {i}" for i in range(30_000))
    long = linededup.drop_repeated_runs(frame(spark, [(1, many), (2, many + "\nlast")]))
    assert as_rows(long, "doc_id", "text") == [(1, many), (2, "last")]


def check_packing(rows, found, vocabulary_path, capacity):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path)
    left = []
    for k, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[at : at + capacity], "<u4")
            left.append((k, piece, at, len(own), zlib.crc32(own.tobytes())))
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert as_rows(found, *names) == sorted(left, key=str)
    sequences = {}
    for r in found.collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r[3] for r in left) // capacity)


def test_packing(spark, awkward, empty):
    path = vocabulary("word_bpe_49k.json")
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    check_packing(rows, packing.pack(awkward, path, capacity=128), path, 128)
    assert packing.pack(empty, path).collect() == []
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    used, least = check_packing(rows, packing.pack(docs, path), path, 2048)
    assert used <= 1.01 * least + 1


def test_plan_holds_everything():
    rng = random.Random(5)
    for capacity in (1, 7, 64, 100, 2048):
        histogram = {}
        for _ in range(400):
            length = rng.randint(1, capacity)
            histogram[length] = histogram.get(length, 0) + rng.randint(1, 50)
        groups = packing.plan(histogram, capacity)
        held = {}
        for g in groups:
            assert g.used <= capacity
            for length, n in g.lengths.items():
                held[length] = held.get(length, 0) + n * g.count
        assert held == histogram


def test_nnls():
    rng = np.random.default_rng(1)
    a, b = rng.random((20, 50)), rng.random(20)
    x = packing.nnls(a, b)
    gradient = a.T @ (a @ x - b)
    assert (x >= 0).all() and (gradient > -1e-6).all() and abs(gradient @ x) < 1e-6


def test_long_runs_of_spaces_and_unbroken_words_equal_the_library():
    table = pieces.PieceTable(vocabulary("piece_bpe_32k.model"))
    for text in (" " * 300_000, "  " + "abcde" * 30_000, "  " + "中文字" * 20_000, " a  b   c" * 5_000):
        ids = np.frombuffer(table.encode(text), "<u4").tolist()
        assert ids == [table.begin, *table.library.encode(text), table.end]


def test_packing_ids_equal_the_library_on_odd_characters():
    path = vocabulary("word_bpe_49k.json")
    plain, ours = Tokenizer.from_file(path), packing.WordEncoder(path)
    rng = random.Random(7)
    letters = [chr(c) for c in range(1, 0x300)] + list("  \n'stremvld²½_0aA") * 30 + ["<|endoftext|>", "漢", "Σ", "́"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["word's " * 60_000, "x" * 5000]
    for text in texts:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == ids
