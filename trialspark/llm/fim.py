"""Fill-in-middle transformation by an indexable skip list.

A text is a list of units: runs of ASCII letters, and every other code point by itself. The list
has express lanes of random nodes; every link carries how many units and how many code points it
spans. A descent from the top lane adds up both widths, so it reaches the unit of a given rank and
its place in the text at once, without counting the units in between.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from trialspark.llm.common import map_batches

# Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
# One node in so many of a lane is also in the next higher one.
FAN = 8


class SkipList:
    """Units of a text under express lanes; built in time linear in the text.

    Lane 0 holds every unit. ``nodes[k]`` are the units that lane k starts a link at, the first
    always among them, and ``units[k]`` and ``points[k]`` the widths of those links.
    """

    def __init__(self, widths: np.ndarray, fan: int = FAN, seed: int = 7):
        self.count = len(widths)
        starts = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
        self.nodes = [np.arange(self.count)]
        toss = np.random.default_rng(seed)
        while len(self.nodes[-1]) > fan:
            below = self.nodes[-1]
            lifted = toss.random(len(below)) < 1 / fan
            lifted[0] = True
            if lifted.all():
                break
            self.nodes.append(below[lifted])
        self.units = [np.diff(own, append=self.count) for own in self.nodes]
        self.points = [np.diff(starts[own], append=starts[-1]) for own in self.nodes]

    def place(self, rank: int) -> int:
        """Code points before the unit with ``rank`` units before it."""
        unit = point = 0
        for lane in range(len(self.nodes) - 1, -1, -1):
            # Where this lane has the node that the lane above stopped at.
            at = int(np.searchsorted(self.nodes[lane], unit))
            units, points = self.units[lane], self.points[lane]
            while at < len(units) and unit + units[at] <= rank:
                unit += int(units[at])
                point += int(points[at])
                at += 1
        return point


def unit_widths(text: str) -> np.ndarray:
    """Code points of every unit: a run of ASCII letters, or one other code point."""
    letters = np.frombuffer(text.encode("utf-32-le"), "<u4") | 32
    letters = (letters >= 97) & (letters <= 122)
    first = np.ones(len(letters), bool)
    first[1:] = ~(letters[1:] & letters[:-1])
    return np.diff(np.flatnonzero(first), append=len(letters))


def drawn(key: Column) -> list[Column]:
    """Four numbers from the key: 32-bit groups of the SHA-256 of ``1:`` and its decimal digits."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [
        F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}")
        for i in range(4)
    ]


def arrange(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(
    docs: DataFrame, plain_from: int = 90, spm_below: int = 20, text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Every document with a middle moved to its end: ``key``, ``n`` (its units), ``form``,
    ``prefix_chars``, ``middle_chars`` and ``output``, the transformed text.

    The cuts lie before units whose ranks are drawn from the key, as the form is. Of a hundred
    documents those from ``plain_from`` on stay as they are, and of the others ``spm_below`` have
    the suffix first. Texts that are empty or contain a mark stay plain too; plain ones have NULL
    lengths. A missing text is an empty one, a missing key is drawn for as one without digits;
    repeated rows are transformed each, other columns are left out, and an empty table gives an
    empty one.
    """
    drawing = docs.select(
        F.col(f"`{key}`").alias("own"), F.col(f"`{text}`").alias("text"), *drawn(F.col(f"`{key}`"))
    )

    def start():
        def work(keys: Sequence, texts: Sequence, *numbers: Sequence) -> dict[str, list]:
            out = {name: [] for name in ("n", "form", "prefix_chars", "middle_chars", "output")}
            for t, h1, h2, h3, h4 in zip(texts, *numbers):
                t = t or ""
                row = (0, "plain", None, None, t)
                if t:
                    units = SkipList(unit_widths(t))
                    n = units.count
                    if h3 % 100 < plain_from and not any(mark in t for mark in MARKS):
                        form = "spm" if h4 % 100 < spm_below else "psm"
                        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                        a, b = units.place(low), units.place(high)
                        row = (n, form, a, b - a, arrange(form, t[:a], t[a:b], t[b:]))
                    else:
                        row = (n, *row[1:])
                for name, value in zip(out, row):
                    out[name].append(value)
            return {"own": keys, **out}

        return work

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(
        drawing, ["own", "text", "h1", "h2", "h3", "h4"],
        f"own {kind}, n long, form string, prefix_chars long, middle_chars long, output string",
        start,
    ).withColumnRenamed("own", key)


def restored(output: Column, form: Column) -> Column:
    """The original text, from a transformed one and its form alone.

    The parts hold no mark, and marks cannot overlap, so each mark is found where it was put.
    """
    prefix_first = F.concat(
        F.substring(F.substring_index(output, SUFFIX, 1), len(PREFIX) + 1, 2**31 - 1),
        F.substring_index(output, MIDDLE, -1),
        F.substring_index(F.substring_index(output, MIDDLE, 1), SUFFIX, -1),
    )
    suffix_first = F.concat(
        F.substring_index(F.substring_index(output, MIDDLE, 1), PREFIX, -1),
        F.substring_index(output, MIDDLE, -1),
        F.substring(F.substring_index(output, PREFIX, 1), len(SUFFIX) + 1, 2**31 - 1),
    )
    return F.when(form == "psm", prefix_first).when(form == "spm", suffix_first).otherwise(output)
