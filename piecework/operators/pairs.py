"""The best pairs of a corpus, held on the driver, and a guess at the merges to come."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field

Pair = tuple[Hashable, Hashable]


@dataclass
class BestPairs:
    """Counts of all pairs that rank before `bound`, and perhaps of others; the most frequent ranks first, then the least `order`.

    Pairs of tokens that exist only ever lose occurrences, and a new token's pairs are counted whole when it is
    made. So a pair that is not held when the bound is set, or ranks behind the bound when it is new, stays behind it:
    the held counts tell the best pair as long as that ranks before the bound. `bound` None: all pairs are held.
    """

    order: Callable[[Pair], tuple]
    bound: tuple | None = None
    counts: dict[Pair, float] = field(default_factory=dict)
    left: dict[Hashable, set[Pair]] = field(default_factory=dict)
    right: dict[Hashable, set[Pair]] = field(default_factory=dict)
    heap: list[tuple] = field(default_factory=list)

    def rank(self, pair: Pair, n: float) -> tuple:
        return (-n, *self.order(pair))

    def add(self, pair: Pair, n: float) -> None:
        """Adds to the count of a pair that is held, or holds it if it ranks before the bound."""
        if pair not in self.counts:
            if n <= 0 or (self.bound is not None and self.rank(pair, n) >= self.bound):
                return
            self.left.setdefault(pair[0], set()).add(pair)
            self.right.setdefault(pair[1], set()).add(pair)
        n = self.counts[pair] = self.counts.get(pair, 0) + n
        if n > 0:
            heapq.heappush(self.heap, (self.rank(pair, n), pair))
        else:
            self.drop(pair)

    def drop(self, pair: Pair) -> None:
        del self.counts[pair]
        self.left[pair[0]].discard(pair)
        self.right[pair[1]].discard(pair)

    def best(self) -> tuple[Pair, float] | None:
        """The best pair and its count; None if no held pair ranks before the bound."""
        while self.heap:
            rank, pair = self.heap[0]
            if self.counts.get(pair) != -rank[0]:
                heapq.heappop(self.heap)
            elif self.bound is not None and rank >= self.bound:
                return None
            else:
                return pair, self.counts[pair]
        return None

    def beside(self, pair: Pair) -> set[Pair]:
        """Held pairs that lose occurrences when `pair` is merged."""
        a, b = pair
        return self.left.get(a, set()) | self.right.get(a, set()) | self.left.get(b, set()) | self.right.get(b, set())

    def copy(self) -> BestPairs:
        sets = lambda d: {k: set(v) for k, v in d.items()}
        return BestPairs(self.order, self.bound, dict(self.counts), sets(self.left), sets(self.right), list(self.heap))

    def guess(
        self, most: int, least: float, name: Callable[[Pair], Hashable], allowed: Callable[[Pair], bool], hint: Callable[[Pair, dict[Pair, Hashable]], list[tuple[Pair, float]] | None]
    ) -> list[tuple[Pair, Hashable]]:
        """The merges that are likely to come next, in order, each with its new token; the first is certain.

        Each merge is played through on a copy, by what `hint` has from an earlier round, or else as if a
        neighbour before or after stood beside all occurrences of the token alike.
        """
        held, out, made = self.copy(), [], {}
        while len(out) < most and (found := held.best()) is not None and found[1] >= least:
            (a, b), n = found
            new = name((a, b))
            out.append(((a, b), new))
            made[a, b] = new
            if (changes := hint((a, b), made)) is not None:
                for pair, change in changes:
                    if pair != (a, b) and (pair in held.counts or (change >= least and allowed(pair))):
                        held.add(pair, change)
                held.drop((a, b))
                continue
            whole = lambda t: max(n, *(sum(held.counts[p] for p in side.get(t, ())) for side in (held.left, held.right)))  # noqa: B023, E731
            before, after = n / whole(a), n / whole(b)
            shares = [(p, (p[0], new), before) for p in held.right.get(a, ())] + [(p, (new, p[1]), after) for p in held.left.get(b, ())]
            for old, fresh, share in shares:
                if old != (a, b):
                    part = held.counts.get(old, 0) * share
                    if part >= least and allowed(fresh):
                        held.add(fresh, part)
                    if old in held.counts:
                        held.add(old, -part)
            held.drop((a, b))
        return out
