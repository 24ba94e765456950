"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piecework.llm.common import cut
from piecework.llm.hashing import blocks

SEQUENCE = 2048
#: Pieces packed together. A group wastes about one sequence, so larger groups pack no better to speak of.
GROUP = 25_000
#: Strings of the vocabulary that stand for one id wherever they are in a text.
SPECIAL = {"<|endoftext|>": 50256}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

class Ids:
    """Ids of texts by a byte-level vocabulary, as a call of its tokenizers file gives them.

    They come from the same vocabulary as ranks, which takes a fraction of the time; texts it refuses (a million
    of white space in a row, say) go through the tokenizers file. No text or chunk is remembered.
    """

    def __init__(self, tokenizer: str, ranks: str, special: dict[str, int]):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranked = tiktoken.Encoding("piecework", pat_str=PATTERN, mergeable_ranks=table, special_tokens=special)
        self.path, self.tokenizer = tokenizer, None

    def of(self, text: str) -> np.ndarray:
        try:
            return self.ranked.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return self.plain(text)

    def plain(self, text: str) -> np.ndarray:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


_WORKER: dict[tuple, Ids] = {}


def cut_pieces(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of `most` but for the first, which takes the rest."""
    first = n % most or most
    return [(0, min(first, n)), *((s, most) for s in range(first, n, most))]


def pieces(docs: DataFrame, tokenizer: str, ranks: str, id_col: str = "doc_id", text_col: str = "text", most: int = SEQUENCE) -> DataFrame:
    """The pieces of each document: its ids by the tokenizer, then id 0, cut if longer than `most`."""
    key = (tokenizer, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _WORKER:
            _WORKER[key] = Ids(tokenizer, ranks, SPECIAL)
        ids = _WORKER[key]
        for batch in blocks(batches, "text"):
            rows: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                data = np.append(ids.of(text.as_py() or ""), 0).astype("<u4").tobytes()
                for k, (s, n) in enumerate(cut_pieces(len(data) // 4, most)):
                    rows.append((doc, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, PIECES)


class OpenBins:
    """Open bins by what is left in them, with a segment tree over 0..most that counts the bins of a range."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, left: int, which: int) -> None:
        if left:
            self.bins[left].append(which)
            self._count(left, 1)

    def _count(self, left: int, by: int) -> None:
        k = left + self.size
        while k:
            self.tree[k] += by
            k >>= 1

    def tightest(self, need: int) -> int | None:
        """The least that is left in any bin with room for `need`: climb to a right neighbour with bins, then go down."""
        k, tree = need + self.size, self.tree
        if tree[k]:
            return need
        while k > 1:
            if not k & 1 and tree[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if tree[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None

    def take(self, left: int) -> int:
        self._count(left, -1)
        return self.bins[left].pop()


def best_fit(lengths: np.ndarray, most: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; `lengths` must not increase and not exceed `most`."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened, left = OpenBins(most), []
    for i, n in enumerate(lengths.tolist()):
        room = opened.tightest(n)
        if room is None:
            which, room = len(left), most
            left.append(most)
        else:
            which = opened.take(room)
        where[i], offset[i] = which, most - room
        left[which] = room - n
        opened.add(room - n, which)
    return where, offset


def pack(found: DataFrame, most: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces (see `pieces`), which are read twice.

    Pieces are dealt one by one, by their place in the written table, into groups of about `group`, whatever their
    ids; each group is packed on its own by best fit decreasing. As the groups are alike and hold thousands of
    sequences, what the split costs is under one sequence a group (tests hold it against one packing of all).
    """
    groups = max(1, round(found.count() / group))
    dealt = found.withColumn("_group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        table = table.sort_by(order)
        where, offset = best_fit(table["length"].to_numpy(), most)
        base = table["_group"][0].as_py() << 32
        return table.drop_columns("_group").append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_group").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str, most: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Tokenises and packs: one row for each piece with its place (see PACKED).

    Null texts count as empty and take one id; null and repeated ids are packed like any row; an empty table
    gives an empty result; other columns are not read. `tokenizer` is the path of a tokenizers file, `ranks` that
    of the same vocabulary as ranks.
    """
    return pack(cut(pieces(docs, tokenizer, ranks, most=most), "pieces"), most, group)
