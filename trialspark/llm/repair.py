"""Repair of the structure of conversations by weighted interval parsing.

A sound conversation has roles ``(s?(ua)+)?``: perhaps a system turn, then user and assistant in
turn. The repair grammar is in Chomsky normal form. Its symbols are ``[p, q]``, what leads from
state p of that expression to state q, and its rules ``[p, q] -> [p, r] [r, q]``, and ``[p, q]`` to
one row, kept, given another role or deleted. A cell holds for a span of rows and a symbol the
least (cost, audit), where the audit lists the edits. Cells of single rows are closed under
insertions on either side; longer spans are combined from shorter ones, bottom-up by length.

Every parse of a span passes some state at each place inside it, so one place of division gives
all parses of a span, and spans can be halved instead of divided at every place. Audits of one
cost and span are never beginnings of each other, since another insertion costs more, so the least
audit of a span is made of the least ones of its parts. Chunks of a conversation are parsed apart,
and their cells are combined in further rounds, however long it is.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trialspark.llm.common import WordCache, map_batches, settle, ship
from trialspark.operators.ordered import row_numbers

# The states of ``(s?(ua)+)?`` (start, after s, after u, after ua) and their steps.
START, OPENED, ASKED, ANSWERED = range(4)
STEPS = {
    (START, "s"): OPENED, (START, "u"): ASKED, (OPENED, "u"): ASKED, (ASKED, "a"): ANSWERED,
    (ANSWERED, "u"): ASKED,
}
FINAL = (START, ANSWERED)
# Costs of edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\f\r"
# A row as one letter: its role's initial (x for another one), as it is, truncated, or to be deleted.
SYMBOLS = "suaxSUAX1234"
CHUNK_BITS = 12
JOINED = 64  # chunks combined by one task in a round

Cells = dict[tuple[int, int], tuple[int, str]]


def combined(left: Cells, right: Cells) -> Cells:
    """Cells of two neighbouring spans as those of one."""
    found: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for (start, q), (more, rest) in right.items():
            if start == r:
                whole = (cost + more, audit + rest)
                if (p, q) not in found or whole < found[p, q]:
                    found[p, q] = whole
    return found


def _least(options: Iterable[tuple[tuple[int, int], tuple[int, str]]]) -> Cells:
    found: Cells = {}
    for symbol, value in options:
        if symbol not in found or value < found[symbol]:
            found[symbol] = value
    return found


@functools.cache
def insertions() -> Cells:
    """Cells of a span without rows: the closure under inserted user and assistant rows."""
    one = {(p, q): (INSERT, "I") for (p, role), q in STEPS.items() if role in "ua"}
    found: Cells = {(p, p): (0, "") for p in range(4)}
    while True:
        more = _least(x for cells in (found, combined(found, one)) for x in cells.items())
        if more == found:
            return found
        found = more


@functools.cache
def leaf(symbol: str) -> Cells:
    """Cells of one row, with insertions before and after it."""
    fault, role = divmod(SYMBOLS.index(symbol), 4)
    options = [((p, p), (DELETE, "D")) for p in range(4)]
    if fault < 2:
        extra = CUT_OFF * fault
        for (p, wanted), q in STEPS.items():
            if wanted == SYMBOLS[role]:
                options.append(((p, q), (extra, "K")))
            if wanted in "ua":
                options.append(((p, q), (extra + REROLE, "R")))
    return combined(combined(insertions(), _least(options)), insertions())


def parse(symbols: str) -> Cells:
    """Cells of a whole chunk, bottom-up: spans of 1, 2, 4, ... rows."""
    spans = [leaf(s) for s in symbols] or [insertions()]
    while len(spans) > 1:
        pairs = [combined(a, b) for a, b in zip(spans[::2], spans[1::2])]
        spans = pairs + spans[len(pairs) * 2 :]
    return spans[0]


def illegal_pairs(symbols: str) -> int:
    roles = [SYMBOLS[SYMBOLS.index(s) % 4] for s in symbols]
    return sum(a + b not in LEGAL for a, b in zip(roles, roles[1:]))


CELLS = "array<struct<p: int, q: int, cost: long, audit: string>>"
CHUNK = f"first string, last string, illegal long, cells {CELLS}"


def _listed(cells: Cells) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in sorted(cells.items())]


def _chunk(symbols: str) -> dict:
    return {
        "first": symbols[0], "last": symbols[-1], "illegal": illegal_pairs(symbols),
        "cells": _listed(parse(symbols)),
    }


def _joined(parts: Sequence[dict]) -> dict:
    """Neighbouring chunks as one."""
    cells = [{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in x["cells"]} for x in parts]
    illegal = sum(x["illegal"] for x in parts)
    illegal += sum(illegal_pairs(a["last"] + b["first"]) for a, b in zip(parts, parts[1:]))
    return {
        "first": parts[0]["first"], "last": parts[-1]["last"], "illegal": illegal,
        "cells": _listed(functools.reduce(combined, cells)),
    }


def _by_group(rows: DataFrame, column: str, work, remember: int) -> DataFrame:
    def start():
        known = WordCache(work, remember) if remember else None

        def batch(convs, chunks, values):
            made = [known[v] if known is not None else work(v) for v in values]
            return {
                "conv": convs, "chunk": chunks,
                **{n: [m[n] for m in made] for n in ("first", "last", "illegal", "cells")},
            }

        return batch

    return map_batches(rows, ["conv", "chunk", column], f"conv string, chunk long, {CHUNK}", start)


def faults(turns: DataFrame) -> DataFrame:
    """Rows without their texts: ``conv``, ``turn``, ``pos``, ``role``, ``fault`` and ``symbol``.

    ``turns`` has ``conv`` (string), ``turn``, ``role`` and ``text``, none missing but ``turn``.
    A conversation's rows are numbered by turn, missing ones first; of equal turns the role and
    then the text's SHA-256 decide, so that only rows that are alike in all of this can change places.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = turns.select(
        "conv", "turn", "role", F.sha2("text", 256).alias("digest"),
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )
    numbered = settle(row_numbers(
        light, ["conv"], ["turn", "role", "digest"], "pos",
        chunk=F.struct(F.col("turn").isNotNull(), F.shiftright(F.col("turn").cast("long"), 20)),
    ))
    first = numbered.groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos"))
    first = first.select("conv", "pos", F.lit(True).alias("new"))
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate")
        .when(F.col("open"), "truncated").otherwise("none")
    )
    kind = F.when(F.col("fault") == "none", 0).when(F.col("fault") == "truncated", 1).otherwise(2)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    return numbered.join(first, ["conv", "pos"], "left").withColumn("fault", fault).select(
        "conv", "turn", "pos", "role", "fault",
        F.substring(F.lit(SYMBOLS), kind * 4 + role, F.lit(1)).alias("symbol"),
    )


def reports(found: DataFrame) -> DataFrame:
    """One row per conversation of ``faults``: counts, ``illegal`` pairs, ``cost`` and ``audit``."""
    counted = found.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"),
        *(F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")),
    )
    spelled = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), ""
    )
    chunks = found.groupBy("conv", F.shiftright(F.col("pos") - 1, CHUNK_BITS).alias("chunk")).agg(
        spelled.alias("symbols")
    )
    parsed = settle(_by_group(chunks, "symbols", _chunk, remember=20_000))
    most = parsed.agg(F.max("chunk")).first()[0] or 0
    while most:
        group = F.floor(F.col("chunk") / JOINED).alias("chunk")
        parts = F.struct("chunk", "first", "last", "illegal", "cells")
        grouped = parsed.groupBy("conv", group).agg(F.array_sort(F.collect_list(parts)).alias("parts"))
        parsed = settle(_by_group(grouped, "parts", _joined, remember=0))
        most //= JOINED
    whole = F.filter("cells", lambda c: (c["p"] == START) & c["q"].isin(*FINAL))
    least = F.array_min(F.transform(whole, lambda c: F.struct(c["cost"].alias("cost"), c["audit"].alias("audit"))))
    best = parsed.select("conv", "illegal", least.alias("least")).select("conv", "illegal", "least.*")
    return counted.withColumn("gaps", F.coalesce("gaps", F.lit(0))).join(best, "conv")


def apply_edits(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired rows: ``conv``, ``place`` (from 0), ``role``, ``text`` and ``edit``.

    ``audits`` has ``conv`` and ``audit``. The rows of a conversation come together and in order.
    They are streamed in the order of ``faults`` behind their audit, so no conversation is held.
    """
    ship(turns.sparkSession)
    rows = turns.select(
        "conv", F.lit(1).alias("part"), "turn", "role", "text", F.sha2("text", 256).alias("digest")
    ).unionByName(audits.select(
        "conv", F.lit(0).alias("part"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"),
        F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("digest"),
    ))
    sorted_rows = rows.repartition("conv").sortWithinPartitions("conv", "part", "turn", "role", "digest")
    schema = pa.schema([
        ("conv", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()),
        ("edit", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, place, system = None, "", 0, 0, 0
        out: list[tuple] = []

        def inserted() -> None:
            nonlocal at, place
            while at < len(audit) and audit[at] == "I":
                out.append((conv, place, due(), "", "I"))
                at, place = at + 1, place + 1

        def due() -> str:
            # With an odd number of rows the first is a system row, and those are always kept.
            return "assistant" if (place - system) % 2 else "user"

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("conv", "part", "role", "text"))
            for own, part, role, text in zip(*columns):
                if part == 0:
                    conv, audit, at, place = own, text, 0, 0
                    system = (len(audit) - audit.count("D")) % 2
                else:
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        out.append((own, place, due() if edit == "R" else role, text, edit))
                        place += 1
                inserted()
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema
                )
                out.clear()

    return sorted_rows.select("conv", "part", "role", "text").mapInArrow(
        run, "conv string, place long, role string, text string, edit string"
    )


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of the lines ``role:text`` of each conversation: ``conv`` and ``repaired_sha256``.

    Takes rows as ``apply_edits`` leaves them, together and in order, so nothing is moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None

        def batch_of(done: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string()) for c in zip(*done)], ["conv", "repaired_sha256"]
            )

        for batch in batches:
            done = []
            columns = (batch[c].to_pylist() for c in ("conv", "role", "text"))
            for own, role, text in zip(*columns):
                if own != conv:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha, line = own, hashlib.sha256(), f"{role}:{text}"
                else:
                    line = f"\n{role}:{text}"
                sha.update(line.encode())
            if done:
                yield batch_of(done)
        if sha is not None:
            yield batch_of([(conv, sha.hexdigest())])

    return repaired.select("conv", "role", "text").mapInArrow(run, "conv string, repaired_sha256 string")


def as_turns(
    conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conv``, ``turn``, ``role`` and ``text`` of any table of conversations.

    ``conv`` is the key as a string, ``+`` and its value, so that a missing key (``-``) is a
    conversation of its own; missing roles and texts are one space.
    """
    return conversations.select(
        conv_name(F.col(f"`{key}`")).alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
    )


def conv_name(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("+"), key.cast("string")), F.lit("-"))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired rows of conversations, given as by ``as_turns``.

    Keeping a row costs nothing, another role 2, deleting 3, inserting an empty user or assistant
    row 2, and a truncated row that stays 1. Blank rows (only spaces and the controls 9 to 13) and
    those whose role and text came earlier are deleted. The reports count rows by their first
    fault of ``blank``, ``duplicate``, ``truncated`` (the last character is not one of ``.!?``),
    ``gaps`` among the known turns, and ``illegal`` neighbours, and give the least ``cost`` and its
    ``audit``, the edits' initials; of equal costs the least in ASCII order.

    Missing turns come first, rows alike are duplicates, an empty table gives empty ones, and a
    conversation whose rows are all deleted has no repaired rows.
    """
    found = settle(reports(faults(turns)))
    return found, apply_edits(turns, found)
