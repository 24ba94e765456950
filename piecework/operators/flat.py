"""Many segments as one array of token numbers: a merge is made on all of them at once."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa

#: Characters of a chunk of segments, as many as the processor's cache holds; and the rows of sums that a task keeps.
CHUNK, KEPT = 1 << 17, 1 << 21
#: Numbers of first tokens by character and place: alone in the segment, its first, its last, or between.
CHARACTERS = 0x110000


#: Columns of packed chunks: token numbers, weights, and the tokens that the numbers stand for.
PACKED = "tokens binary, weights binary, names array<string>"


class Numbers:
    """Tokens to numbers, from 1 on; 0 stands between segments. First tokens are known by character and place."""

    def __init__(self, start: Callable[[str], list]):
        self.start, self.names, self.number = start, [None], {None: 0}
        self.first = np.full(4 * CHARACTERS, -1, np.int32)

    def of(self, token: Hashable) -> int:
        if token not in self.number:
            self.number[token] = len(self.names)
            self.names.append(token)
        return self.number[token]

    def of_characters(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of first tokens; a key is four times the code point, plus 2 if it begins and 1 if it ends the segment."""
        found = self.first[keys]
        if (missing := found < 0).any():
            for key in np.unique(keys[missing]).tolist():
                c = chr(key >> 2)
                token = (self.start(c * 3)[1], self.start(c * 2)[1], self.start(c * 2)[0], self.start(c)[0])[key & 3]
                self.first[key] = self.of(token)
            found = self.first[keys]
        return found


class FlatSegments:
    """Segments with their weights; `tokens` has their tokens' numbers one after the other, with a 0 before each and at the end."""

    def __init__(self, segments: list[str], weights: np.ndarray, numbers: Numbers, from_right: bool):
        self.numbers, self.weights, self.from_right = numbers, weights, from_right
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        # Places in the array: a segment's characters follow its 0.
        heads = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.tokens = np.zeros(heads[-1] + 1, np.int32)
        self.owner = np.repeat(np.arange(len(segments) + 1, dtype=np.int32), [*(sizes + 1), 1])
        inner = np.ones(len(self.tokens), bool)
        inner[heads] = False
        keys = np.zeros(len(self.tokens), np.int64)
        keys[inner] = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) << 2
        some = sizes > 0
        keys[heads[:-1][some] + 1] |= 2
        keys[heads[1:][some] - 1] |= 1
        self.tokens[inner] = numbers.of_characters(keys[inner])

    @classmethod
    def read(cls, batches: Iterator[pa.RecordBatch], start: Callable[[str], list], from_right: bool) -> Iterator[FlatSegments]:
        """The rows (seg, w) of `batches` in chunks of about CHUNK characters, or packed chunks, all with the same numbers."""
        numbers, held, weights, size = Numbers(start), [], [], 0
        for batch in batches:
            if "seg" not in batch.schema.names:
                for row in zip(batch["tokens"], batch["weights"], batch["names"], strict=True):
                    yield cls.unpacked(*(x.as_py() for x in row), numbers, from_right)
                continue
            for s, w in zip(batch["seg"].to_pylist(), batch["w"].to_pylist(), strict=True):
                held.append(s)
                weights.append(w)
                size += len(s) + 1
                if size >= CHUNK:
                    yield cls(held, np.array(weights, np.int64), numbers, from_right)
                    held, weights, size = [], [], 0
        if held:
            yield cls(held, np.array(weights, np.int64), numbers, from_right)

    def packed(self) -> pa.RecordBatch:
        there = np.bincount(self.tokens, minlength=len(self.names)) > 0
        row = [self.names[i] for i in np.flatnonzero(there)]
        at = (np.cumsum(there) - 1).astype(_width(row))[self.tokens]
        columns = [pa.array([at.tobytes()]), pa.array([self.weights.tobytes()]), pa.array([row], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["tokens", "weights", "names"])

    @classmethod
    def unpacked(cls, tokens: bytes, weights: bytes, names: list, numbers: Numbers, from_right: bool) -> FlatSegments:
        out = cls.__new__(cls)
        out.numbers, out.weights, out.from_right = numbers, np.frombuffer(weights, np.int64), from_right
        out.tokens = np.array([numbers.of(t) for t in names], np.int32)[np.frombuffer(tokens, _width(names))]
        out.owner = (np.cumsum(out.tokens == 0) - 1).astype(np.int32)
        return out

    @property
    def names(self) -> list:
        return self.numbers.names

    def present(self) -> list:
        return [self.names[i] for i in np.unique(self.tokens) if i]

    def coded(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that begin at `places` as one number each, and their segments' weights; none reaches over a 0."""
        a, b = self.tokens[places].astype(np.int64), self.tokens[places + 1].astype(np.int64)
        inside = (a > 0) & (b > 0)
        return (a << 32 | b)[inside], self.weights[self.owner[places[inside]]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return self.coded(np.arange(len(self.tokens) - 1))

    def merge(self, pair: tuple, new: Hashable, changes: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
        """Makes every `pair` one token, equal neighbours from the right or the left.

        With `changes` the pairs that go, with weights below 0, and those that come, each if there are any.
        """
        a, b = map(self.numbers.of, pair)
        tokens = self.tokens
        at = tokens[:-1] == a
        at &= tokens[1:] == b
        if not at.any():
            return []
        hits = np.flatnonzero(at)
        if a == b:
            # Of neighbouring hits every second one, counted from the end of the run that comes first.
            order = -hits[::-1] if self.from_right else hits
            starts = np.flatnonzero(np.diff(order, prepend=order[0] - 2) != 1)
            place = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
            order = order[place % 2 == 0]
            hits = -order[::-1] if self.from_right else order
        out = []
        if changes:
            codes, weights = self.coded(_ascending(hits[:, None] + np.array([-1, 0, 1])))
            out.append((codes, -weights))
        keep = np.ones(len(tokens), bool)
        keep[hits + 1] = False
        tokens[hits] = self.numbers.of(new)
        self.tokens, self.owner = tokens[keep], self.owner[keep]
        if changes:
            now = hits - np.arange(len(hits))
            codes, weights = self.coded(_ascending(now[:, None] + np.array([-1, 0])))
            if len(codes):
                out.append((codes, weights))
        return out

    def lists(self, show: Callable[[Hashable], str]) -> pa.ListArray:
        """Each segment's tokens as they are shown."""
        inner = self.tokens > 0
        counts = np.bincount(self.owner[inner], minlength=len(self.weights))
        some, at = np.unique(self.tokens[inner], return_inverse=True)
        shown = pa.array([show(self.names[i]) for i in some], pa.string()).take(pa.array(at))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), shown)


def _width(names: list) -> type:
    """The kind of the numbers of so many tokens in packed chunks."""
    return np.uint16 if len(names) <= 1 << 16 else np.int32


def _ascending(places: np.ndarray) -> np.ndarray:
    """The distinct places around hits, in order: hits are two places apart or more, so equal ones follow each other."""
    found = places.ravel()
    return found[np.diff(found, prepend=found[0] - 1) != 0]


class Sums:
    """Sums of weights by step and pair, kept as arrays."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, step: int, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Adds the weights of pairs, and gives the distinct pairs."""
        order = np.argsort(codes)
        found = codes[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(found) != 0])) if len(found) else np.zeros(0, np.int64)
        # Exact in whole numbers.
        found, sums = found[first], np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64)
        self.parts.append((np.full(len(found), step, np.int32), found, sums))
        self.rows += len(found)
        if self.rows > KEPT:
            self.fold()
        return found

    def fold(self) -> None:
        if not self.parts:
            return
        steps, codes, sums = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((codes, steps))
        steps, codes, sums = steps[order], codes[order], sums[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(codes) != 0) | (np.diff(steps) != 0)])) if len(codes) else np.zeros(0, np.int64)
        sums = np.add.reduceat(sums, first) if len(first) else sums
        self.parts, self.rows = [(steps[first], codes[first], sums)], len(first)

    def full(self) -> bool:
        """Whether many rows are left even when they are summed."""
        return self.rows > KEPT // 2 and (self.fold() or self.rows > KEPT // 2)

    def batch(self, names: list, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> pa.RecordBatch:
        """The sums as rows a, b, step, n, of the pairs that are `wanted`; they start anew."""
        self.fold()
        steps, codes, sums = self.parts[0]
        self.parts, self.rows = [], 0
        a, b = codes >> 32, codes & 0xFFFFFFFF
        kept = sums != 0
        if wanted is not None:
            kept &= wanted(a, b)
        shown = pa.array(names, pa.string())
        columns = [shown.take(pa.array(a[kept])), shown.take(pa.array(b[kept])), pa.array(steps[kept]), pa.array(sums[kept])]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "step", "n"])
