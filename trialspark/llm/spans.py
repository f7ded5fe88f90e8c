"""Spans in texts: order, digests and removal. Places are code points, ends exclusive."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Sequence

Span = tuple[str, int, int]  # kind, start, end


def in_order(spans: Iterable[Span], kinds: Sequence[str]) -> list[Span]:
    """By start, then kind as listed, then end."""
    rank = {kind: i for i, kind in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def as_string(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans: Iterable[Span]) -> str:
    return hashlib.sha256(as_string(spans).encode()).hexdigest()


class Cover:
    """Places covered by spans, as sorted disjoint stretches."""

    def __init__(self, spans: Iterable[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, span: Span) -> bool:
        at = bisect_left(self.starts, span[2])
        return at > 0 and self.ends[at - 1] > span[1]

    def add(self, span: Span) -> None:
        """Cover a span that meets none so far."""
        at = bisect_left(self.starts, span[1])
        self.starts.insert(at, span[1])
        self.ends.insert(at, span[2])


def replace(text: str, spans: Sequence[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping ones become one."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]
