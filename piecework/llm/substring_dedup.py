"""Substring dedup by suffix trees, dealt by prefixes of variable length.

Every word starts a suffix; what lies `window` words below the root decides. Suffixes are read as a prefix and
the symbols of the words behind it:

1. Filter. Of every `window` consecutive words one anchor, a run of `ANCHOR` words chosen by least hash, is
   counted; equal windows have equal anchors. A suffix whose anchor occurs once shares no path of `window` words.
2. Prefixes. A suffix belongs to the group of its first 4 words. Where so many suffixes begin alike that the group
   would be too large, it is split by the first 8 words, and so on to 12 and 16 and, at last, all `window` words.
   Which prefixes are too large is counted over all texts: no group but those of whole windows holds more than a
   fixed share of all suffixes. A task settles the repeats of whole windows among its own suffixes before it
   sends them, so that a passage found everywhere arrives once from each task.
3. Subtrees. Spark sorts each group's suffixes by path. The length of the common prefix of neighbours is the depth
   of the internal node that joins them; runs joined at `window` words or deeper are the leaves of a deep node. Of
   such a run the earliest leaf stays. Spans of leaves that touch merge to the maximal repeats.

A suffix travels as 32 bits of its group's prefix, its path (a byte for every four words behind the first four) and a 64-bit hash of all `window` words, which alone tells a deep node: windows of different words share it with a
chance of about 2**-64 a pair. The depths of shallower nodes may come out too large by a chance of 1 in 256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piecework.llm.bitmap import collect_bitmap, hits
from piecework.llm.common import cut, task_count
from piecework.llm.hashing import blocks, join, word_hashes

WINDOW = 20
ANCHOR = 4
#: Lengths of prefixes that suffixes are dealt by, before the whole window.
LENGTHS = (4, 8, 12, 16)
#: Suffixes a task gathers before it settles repeats among them and sends the rest.
GATHER = 2_000_000
#: A prefix that begins so many of GATHER suffixes is reported; one with twice this share of all suffixes is split.
LARGE = 64
SPANS = "row long, start int, stop int"
#: Texts without an id come after all others.
LAST = (1 << 63) - 1


class Windows:
    """The windows of a text array: `owner` (text number) and `start`, and by `prefix` and `path` what they read."""

    def __init__(self, texts: pa.Array, window: int):
        words, counts = word_hashes(texts)
        self.window, self.n = window, max(0, len(words) - window + 1)
        first = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(self.n)
        self.at = at[owner[: self.n] == owner[window - 1 :]] if self.n else at
        self.owner = owner[self.at]
        self.start = self.at - first[self.owner]
        self.words = words
        if self.n:
            self.two = join(words[:-1], words[1:])
            self.four = join(self.two[:-2], self.two[2:])

    def prefix(self, length: int) -> np.ndarray:
        """A hash of the first words of each window; `length` is a multiple of 4 or the window."""
        if not self.n:
            return np.zeros(0, np.uint64)
        h = self.four[self.at]
        for k in range(4, length - 3, 4):
            h = join(h, self.four[self.at + k])
        return join(h, self.four[self.at + length - 4]) if length % 4 else h

    def path(self) -> np.ndarray:
        """The words behind the first four, a byte for every four, the first in the highest of 32 bits."""
        out = np.zeros(len(self.at), np.uint64)
        for i in range((self.window - 4) // 4):
            out |= (self.four[self.at + 4 + 4 * i] >> np.uint64(56)) << np.uint64(24 - 8 * i)
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The anchor of each window, and whether it stands at another place than that of the window before."""
        if not self.n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        # The least of the runs in each window, by doubling.
        span, least = 1, self.four
        while 2 * span <= self.window - ANCHOR + 1:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = self.window - ANCHOR + 1 - span
        least = np.minimum(least[: self.n], least[rest:][: self.n])
        # An anchor stands at its leftmost place. Once the window moves past it, the same hash means another place.
        fresh = np.ones(self.n, bool)
        fresh[1:] = (least[1:] != least[:-1]) | (self.four[: self.n - 1] == least[:-1])
        return least[self.at], fresh[self.at] | (self.start == 0)


def _spans(doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word spans that windows (sorted by document and start) cover, touching ones merged."""
    if not len(doc):
        return doc, start, start
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + window)])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], start[last] + window


def common_symbols(path: np.ndarray) -> np.ndarray:
    """How many of the 8 symbols of each path, from the first, are as in the path before it (the first of all: 0)."""
    differ = (path[1:] ^ path[:-1]).view(np.uint64)
    out = np.full(len(path), 8)
    out[:1] = 0
    for k in range(7, -1, -1):
        out[1:][(differ >> np.uint64(56 - 8 * k)) & np.uint64(0xFF) != 0] = k
    return out


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, row: a written copy, which fixes the row numbers that tell repeated and null ids apart."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cut(texts.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")


def _counts(texts: DataFrame, window: int) -> DataFrame:
    """kind, key, n, more: anchors (kind 0; more: twice in a block of texts), prefixes that begin many suffixes of a
    block (kind: their length), and the number of all suffixes (kind -1)."""
    lengths = [k for k in LENGTHS if k < window]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {k: [] for k in lengths}

        def rows(kind: int, keys: np.ndarray, n: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(more)]
            return pa.RecordBatch.from_arrays(columns, ["kind", "key", "n", "more"])

        def settle() -> Iterator[pa.RecordBatch]:
            for k, found in held.items():
                if found:
                    keys, n = np.unique(np.concatenate(found), return_counts=True)
                    found.clear()
                    yield rows(k, keys[n >= LARGE], n[n >= LARGE], np.zeros(int((n >= LARGE).sum()), bool))

        size = total = 0
        for batch in blocks(batches, "text"):
            w = Windows(batch["text"], window)
            anchor, fresh = w.anchors()
            keys, n = np.unique(anchor[fresh], return_counts=True)
            yield rows(0, keys, n, n > 1)
            for k in lengths:
                held[k].append(w.prefix(k))
            size, total = size + len(w.at), total + len(w.at)
            # Each length holds as many hashes, so blocks are a quarter of what is gathered later.
            if 4 * size >= GATHER:
                yield from settle()
                size = 0
        yield from settle()
        yield rows(-1, np.zeros(1, np.uint64), np.array([total]), np.zeros(1, bool))

    found = texts.mapInArrow(run, "kind int, key long, n long, more boolean")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.max("more").alias("more"))


def repeated_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Word spans (row, start, stop) of `numbered` texts that windows cover whose words also start earlier; they may overlap.

    Earlier is a smaller id, a smaller row number of the same id, or an earlier start in the same row. Words are
    compared unchanged. `window` is 8 to 20 words.
    """
    if not 8 <= window <= 20:
        raise ValueError("window must be 8 to 20 words")
    spark = rows.sparkSession
    texts = rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "row", "text")
    counted = cut(_counts(texts, window).where("kind <> 0 OR more OR n > 1"), "suffix-counts")
    shared = spark.sparkContext.broadcast(collect_bitmap(counted.where("kind = 0").select("key"), "key"))
    total = counted.where("kind = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Prefixes with so large a share are few, whatever the size of the input: under GATHER / LARGE for each length.
    share = max(LARGE, 4 * LARGE * total // GATHER)
    large: dict[int, list[int]] = {}
    for r in counted.where((F.col("kind") > 0) & (F.col("n") >= share)).select("kind", "key").toLocalIterator():
        large.setdefault(r["kind"], []).append(r["key"])
    split = spark.sparkContext.broadcast([(k, np.sort(np.array(v, np.int64)).view(np.uint64)) for k, v in sorted(large.items())])

    def groups(w: Windows, keep: np.ndarray) -> np.ndarray:
        """The group of each kept window: a hash of the shortest prefix that is not too large, of the window at most."""
        key, open_ = w.prefix(4)[keep], np.arange(int(keep.sum()))
        lengths = [k for k in LENGTHS if k < window]
        for i, k in enumerate(lengths):
            known = dict(split.value).get(k)
            if known is None or not len(open_):
                break
            known = np.sort(known)
            here = key[open_]
            at = np.minimum(np.searchsorted(known, here), len(known) - 1)
            open_ = open_[known[at] == here]
            longer = lengths[i + 1] if i + 1 < len(lengths) else window
            key[open_] = w.prefix(longer)[keep][open_]
        return key

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def settle() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            key, whole, doc, row, start = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((start, row, doc, whole))
            later = np.zeros(len(order), bool)
            later[1:] = whole[order[1:]] == whole[order[:-1]]
            first, later = order[~later], order[later]
            yield leaf(key[first], whole[first].view(np.int64), doc[first], row[first], start[first], np.zeros(len(first), np.int64))
            row, start = row[later], start[later]
            order = np.lexsort((start, row))
            row, start, stop = _spans(row[order], start[order], window)
            # Spans settled here travel with the leaves, spread by their own hash.
            none = np.zeros(len(row), np.int64)
            yield leaf(join(row.view(np.uint64), start.astype(np.uint64)), none, none, row, start, stop - start)

        def leaf(key, whole, doc, row, start, length) -> pa.RecordBatch:  # noqa: ANN001
            # Start and length in one integer, which sorts as the start; a leaf has the length 0, a settled span its own.
            span = (start.astype(np.int64) << 32) | length
            columns = [*map(pa.array, (key.view(np.int64), whole, doc, row, span))]
            return pa.RecordBatch.from_arrays(columns, ["key", "whole", "doc_id", "row", "span"])

        n = 0
        for batch in blocks(batches, "text"):
            w = Windows(batch["text"], window)
            keep = hits(shared.value, w.anchors()[0])
            doc, row = (batch[c].to_numpy()[w.owner[keep]] for c in ("doc_id", "row"))
            key = (groups(w, keep) >> np.uint64(32) << np.uint64(32)) | w.path()[keep]
            held.append((key, w.prefix(window)[keep], doc, row, w.start[keep]))
            n += int(keep.sum())
            if n >= GATHER // 2:
                yield from settle()
                n = 0
        yield from settle()

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            key, whole, row, span = (batch[k].to_numpy() for k in ("key", "whole", "row", "span"))
            start, stop = span >> 32, (span >> 32) + (span & 0xFFFFFFFF)
            settled = stop > start
            g, w, r, s = (x[~settled] for x in (key, whole, row, start))
            deep = np.zeros(len(g), bool)
            if len(g):
                # Depth of the node that joins a suffix with the one before it; the first four symbols are the group's.
                same = common_symbols(g)
                depth = np.where(same < 4, 0, np.minimum(ANCHOR + 4 * (same - 4), window - 1))
                depth[1:][(w[1:] == w[:-1]) & (g[1:] == g[:-1])] = window
                deep = depth >= window
                deep[0] = (g[0], w[0]) == last
                last = (g[-1], w[-1])
            r, s = np.concatenate([r[deep], row[settled]]), np.concatenate([s[deep], start[settled]])
            e = np.concatenate([s[: int(deep.sum())] + window, stop[settled]])
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["row", "start", "stop"])

    leaves = texts.mapInArrow(suffixes, "key long, whole long, doc_id long, row long, span long")
    leaves = leaves.repartition(task_count(spark), F.shiftright("key", 32)).sortWithinPartitions("key", "whole", "doc_id", "row", "span")
    return leaves.mapInArrow(subtrees, SPANS)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed word spans, merged and in order), kept_text: one row a document.

    Null texts have no words; null ids come after all others; rows of one id are texts of their own, in the
    order of a written copy; other columns are not read.
    """
    # A document's spans are few once touching ones are merged, however often its words repeat.
    texts = numbered(docs, id_col, text_col)
    marked = repeated_spans(texts, window).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("found"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            rows = []
            for text, found in zip(batch["text"], batch["found"], strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                merged: list[dict] = []
                if found.is_valid and len(found):
                    flat = found.values
                    start, stop = flat.field("start").to_numpy(), flat.field("stop").to_numpy()
                    drop = np.zeros(len(words) + 1, np.int32)
                    np.add.at(drop, start, 1)
                    np.add.at(drop, stop, -1)
                    gone = np.cumsum(drop[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    merged = [{"start": int(a), "stop": int(b)} for a, b in edge.reshape(-1, 2)]
                    kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                else:
                    kept = words
                rows.append((len(words), len(words) - len(kept), merged, b" ".join(kept).decode("utf-8", "surrogatepass")))
            n, removed, spans, kept = zip(*rows, strict=True) if rows else ([], [], [], [])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            columns = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,stop:int>>, kept_text string"
    joined = texts.join(cut(marked, "repeated-spans"), "row", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(rewrite, schema)


def substring_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_spans."""
    found = substring_dedup(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))
