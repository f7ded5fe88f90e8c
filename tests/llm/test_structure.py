"""Fill-in-middle and conversation repair, against plain versions."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from tests.compare import connect, difference
from trialspark.llm import fim, queries, repair, sql

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")
TEXTS = [
    None, "", " ", "a", "ab cd", "no mark here", "has <P> mark", "<S>", "<M", "<<P", "x\ny\r\n z",
    "äöü straße 漢字 👍🏽 é", "'''", "a1b2c3", "word " * 4000, "x" * 50_000, " " * 5000, "a<b>c<S",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(key, text):
    text = text or ""
    h = sha(f"1:{'' if key is None else key}")
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 20:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_every_rank_of_the_skip_list():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 8, 9, 100, 3000):
        widths = rng.integers(1, 9, n)
        before = np.concatenate([[0], np.cumsum(widths)])
        made = fim.SkipList(widths)
        assert n < 100 or len(made.nodes) > 2
        ranks = range(n + 1) if n < 200 else [0, 1, n // 3, n - 1, n]
        assert [made.place(r) for r in ranks] == [before[r] for r in ranks]


def test_fill_in_middle_on_odd_rows(spark):
    rows = [(i, t, "own") for i, t in enumerate(TEXTS * 4)] + [(None, "keyless words", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    moved = fim.transform(docs)
    found = moved.select("*", fim.restored(moved["output"], moved["form"]).alias("back")).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert [tuple(r)[:6] for r in sorted(found, key=key)] == [plain_fim(k, t) for k, t, _ in rows]
    assert sorted(r.back for r in found) == sorted(t or "" for _, t, _ in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), sql.STATEMENTS[name]) == ""


def damage(rows):
    """Rows (conv, turn, role, text) after planted faults."""
    out = []
    for conv, turn, role, text in rows:
        conv, turn_name = ("-" if conv is None else f"+{conv}"), " " if turn is None else turn
        code = zlib.crc32(f"{' ' if conv == '-' else conv[1:]}:{turn_name}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if code:
            role = "user" if code == 4 else role
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(conv, turn, role, text)] * (1 + (code == 3))
    return out


def plain_repair(rows):
    """Least (cost, audit) of rows (role, text) in order, by search over edits; and the counts."""
    kinds, seen = [], set()
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\f\r")
        kinds.append(
            "blank" if not body else "duplicate" if (role, text) in seen
            else "truncated" if body[-1] not in ".!?" else "none"
        )
        seen.add((role, text))
    steps = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            break
        for role in steps[state]:
            if role != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", at, role))
        if at < len(rows):
            extra = kinds[at] == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state))
            if kinds[at] in ("none", "truncated"):
                for role in steps[state]:
                    if rows[at][0][:1] == role:
                        heapq.heappush(heap, (cost + extra, audit + "K", at + 1, role))
                    if role != "s":
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", at + 1, role))
    lines, at, total = [], 0, len(audit) - audit.count("D")
    for edit in audit:
        due = "assistant" if (len(lines) - total % 2) % 2 else "user"
        if edit == "K":
            lines.append(":".join(rows[at]))
        elif edit == "R":
            lines.append(f"{due}:{rows[at][1]}")
        elif edit == "I":
            lines.append(f"{due}:")
        at += edit != "I"
    roles = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
    return [*counts, illegal, cost, audit, sha("\n".join(lines))]


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?", "More. ", "later...", None]
    roles = ["system", "user", "assistant", "tool", "", None, "user", "assistant"]
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randint(1, longest)):
            turn = rng.choice([turn, turn, turn, turn + 2, None])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts)))
    return rows


def test_repair_against_search(spark, monkeypatch):
    """Also with chunks of four rows, so that long conversations are combined in rounds."""
    monkeypatch.setattr(repair, "CHUNK_BITS", 2)
    monkeypatch.setattr(repair, "JOINED", 3)
    rows = random_rows(5, 150, 9) + [("long", i, random.Random(i).choice(["user", "assistant", "system"]),
                                      random.Random(-i).choice(["Yes.", "cut", f"{i}."])) for i in range(90)]
    rows = [(None if c is None else str(c), t, r, x) for c, t, r, x in rows]
    table = spark.createDataFrame(
        [(*r, "x") for r in rows], "conv_id string, turn long, role string, text string, conv string"
    )
    reports, repaired = repair.repair(repair.as_turns(queries.damaged(table)))
    found = reports.join(repair.digests(repaired), "conv", "left").collect()
    by_conv = {}
    for conv, turn, role, text in damage(rows):
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role, sha(text), text))
    expected = {}
    for conv, own in by_conv.items():
        own.sort()
        known = [turn for there, turn, *_ in own if there]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        expected[conv] = [gaps, *plain_repair([(role, text) for _, _, role, _, text in own])]
    assert len(found) == len(expected)
    for r in found:
        got = [r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")]
        assert [*got, r.repaired_sha256 or sha("")] == expected[r.conv], r.conv


def test_repaired_rows_are_sound(spark):
    rows = [(str(c), *r) for c, *r in random_rows(8, 60, 8)]
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    _, repaired = repair.repair(repair.as_turns(table))
    by_conv = {}
    for r in repaired.collect():
        by_conv.setdefault(r.conv, []).append((r.place, r.role, r.text, r.edit))
    for own in by_conv.values():
        assert [r[0] for r in own] == list(range(len(own)))
        assert re.fullmatch("s?(ua)+", "".join(r[1][:1] for r in own))
        assert all(r[2] == "" for r in own if r[3] == "I")


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    reports, repaired = repair.repair(repair.as_turns(empty))
    assert reports.collect() == [] and repaired.collect() == [] and repair.digests(repaired).collect() == []
