"""Merging neighbours in a list of tokens: by rank with a heap, and step by step with the pairs that come and go."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Hashable, Iterator


def merge_by_rank(tokens: list, rank: Callable[[Hashable, Hashable], tuple | None], join: Callable, from_right: bool) -> list:
    """Joins all neighbours of the least rank, again and again; equal neighbours from the right or the left.

    `rank(a, b)` is unique to a pair, None where it must not be joined. A heap of places and links between them keep
    the cost near the number of tokens.
    """
    tokens, n = list(tokens), len(tokens)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap: list[tuple] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (r := rank(tokens[i], tokens[after[i]])) is not None:
            heapq.heappush(heap, (r, -i if from_right else i))

    for i in range(n - 1):
        offer(i)
    while heap:
        best = heap[0][0]
        places = []
        while heap and heap[0][0] == best:
            places.append(abs(heapq.heappop(heap)[1]))
        for i in places:
            j = after[i]
            if tokens[i] is None or j < 0 or rank(tokens[i], tokens[j]) != best:
                continue
            tokens[i], tokens[j], after[i] = join(tokens[i], tokens[j]), None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
    return [t for t in tokens if t is not None]


def merged_once(tokens: list, a: Hashable, b: Hashable, new: Hashable, from_right: bool) -> list:
    """Every (a, b) as `new`; equal neighbours from the right or the left."""
    back = from_right and a == b
    source, out, i = (tokens[::-1] if back else tokens), [], 0
    while i < len(source):
        hit = source[i] == a and i + 1 < len(source) and source[i + 1] == b
        out.append(new if hit else source[i])
        i += 1 + hit
    return out[::-1] if back else out


def merge_in_order(tokens: list, ranks: dict[tuple, tuple[int, Hashable]], from_right: bool) -> list:
    """Joins neighbours by `ranks` (pair to rank and merged token) as `merge_by_rank` does; short lists are looked through anew for each merge."""
    if len(tokens) > 24:
        return merge_by_rank(tokens, lambda a, b: (ranks[a, b][0],) if (a, b) in ranks else None, lambda a, b: ranks[a, b][1], from_right)
    while True:
        best = None
        for p in zip(tokens, tokens[1:], strict=False):
            if (found := ranks.get(p)) is not None and (best is None or found[0] < best[0]):
                best, pair = found, p
        if best is None:
            return tokens
        tokens = merged_once(tokens, *pair, best[1], from_right)


def stepwise(tokens: list, steps: dict[tuple, tuple[int, Hashable]], from_right: bool) -> Iterator[tuple[int, dict[tuple, int]]]:
    """Applies `steps` (pair to number and merged token) in the order of their numbers; for each that changes the
    tokens its number and by how much the counts of adjacent pairs, overlapping ones included, change."""
    before, number = list(zip(tokens, tokens[1:], strict=False)), -1
    while found := [(*steps[p], p) for p in before if p in steps and steps[p][0] > number]:
        number, new, (a, b) = min(found, key=lambda f: f[0])
        tokens = merged_once(tokens, a, b, new, from_right)
        now, change = list(zip(tokens, tokens[1:], strict=False)), {}
        for p in now:
            change[p] = change.get(p, 0) + 1
        for p in before:
            change[p] = change.get(p, 0) - 1
        yield number, change
        before = now
