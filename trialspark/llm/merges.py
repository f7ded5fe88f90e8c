"""Which neighbouring tokens survive merging, for vocabularies built by merging pairs.

A sequence of tokens is the encoding of its text exactly when every neighbouring pair is the
encoding of its own joined text, so one test for pairs is all that prefix tables need.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from trialspark.llm.common import WordCache

NEVER = 1 << 60


class PairTest:
    """Pair compatibility from the rank of merging two neighbours (None: they never merge).

    Lower ranks merge first, and of equal ones the leftmost. ``remember`` bounds the results
    kept by a worker.
    """

    def __init__(self, rank: Callable[[str, str], int | None], remember: int = 1_000_000):
        self.rank = rank
        self.trees: dict[str, tuple[str, str, int] | None] = {}
        self.results = WordCache(self._test, remember // 2)

    def merge(self, symbols: Sequence[str]) -> tuple[list[str], tuple[str, str, int] | None]:
        """Merge neighbours until none is left; also the last merge made.

        Pairs wait in a heap by rank and place, and the symbols are a linked list, so that the time
        grows with n log n. A pair is out of date when one of its symbols has changed since.
        """
        own: list[str | None] = list(symbols)
        size, made = len(own), None
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        waiting: list[tuple[int, int, str, str]] = []

        def wait(at: int) -> None:
            then = after[at]
            if at >= 0 and then < size:
                cost = self._cost(own[at], own[then])
                if cost != NEVER:
                    heapq.heappush(waiting, (cost, at, own[at], own[then]))

        for at in range(size - 1):
            wait(at)
        while waiting:
            cost, at, left, right = heapq.heappop(waiting)
            then = after[at]
            if own[at] != left or then >= size or own[then] != right:
                continue
            made = (left, right, cost)
            own[at], own[then] = left + right, None
            after[at] = after[then]
            if after[at] < size:
                before[after[at]] = at
            wait(at)
            if before[at] >= 0:
                wait(before[at])
        return [x for x in own if x is not None], made

    def _cost(self, a: str, b: str) -> int:
        found = self.rank(a, b)
        return NEVER if found is None else found

    def tree(self, token: str) -> tuple[str, str, int] | None:
        """Left part, right part and rank of the merge that makes a token.

        A single letter gives two empty parts; a token that merging never makes gives None.
        """
        if token not in self.trees:
            symbols, made = self.merge(token) if len(token) > 1 else ([token], ("", "", -1))
            self.trees[token] = made if symbols == [token] else None
        return self.trees[token]

    def _edge(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """Symbols at one end of a token from last to first: symbol, made at, taken up at."""
        steps, taken = [], NEVER
        while token:
            made = self.tree(token)
            steps.append((token, made[2], taken))
            token, taken = made[side], made[2]
        return steps

    def survive(self, left: str, right: str) -> bool:
        """Whether the joined text of two tokens is encoded as these two; "" starts a text."""
        return self.results[left, right]

    def _test(self, pair: tuple[str, str]) -> bool:
        left, right = pair
        if self.tree(right) is None or left and self.tree(left) is None:
            return False
        if not left:
            return True
        ends, starts = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (a, a_made, a_taken), (b, b_made, b_taken) = ends[i], starts[j]
            rank = self.rank(a, b)
            if rank is not None and rank < a_taken and rank <= b_taken:
                return False
            if a_made > b_made and i + 1 < len(ends):
                i += 1
            elif j + 1 < len(starts):
                j += 1
            elif i + 1 < len(ends):
                i += 1
            else:
                return True
