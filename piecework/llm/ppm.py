"""Language-model scores: a unigram base, and prediction by partial matching over bytes.

Training texts are lower-cased (A-Z), their words joined by one space and closed by an end mark. Counts of byte
strings are gathered over all training texts. A symbol is coded at the longest context that was seen; a context
that lacks it is left by an escape (method C: one escape for each distinct symbol), and what it did offer is
excluded below. At the end all remaining bytes are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piecework.llm.common import cut, task_count
from piecework.llm.hashing import blocks, word_hashes
from piecework.llm.toxicity import held_out

#: Bytes of context.
ORDER = 5
#: Byte strings whose scores are broadcast: the most frequent ones, 16 bytes each; the scores of all others come by a join.
NODES = 1 << 20
#: Bytes of context by which counts are dealt to tasks. Contexts shorter than this are broadcast, 2**(8 * NEAR) strings at most.
NEAR = 2
#: Words whose counts are broadcast; the counts of all others come by a join.
WORDS = 1 << 19
#: Distinct byte strings a task gathers before it sends their counts.
GATHER = 2_000_000
END = 10


def streams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts as trained and scored, an end mark after each, and how many each has."""
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    parts = [b" ".join((x.as_py() or "").encode("utf-8", "surrogatepass").translate(lower).split()) + bytes([END]) for x in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.array([len(x) for x in parts], np.int64)


def strings(data: np.ndarray, sizes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Each byte with the `order` bytes before it, as an integer; end marks stand before a text."""
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(data))
    out = data.astype(np.uint64)
    for k in range(1, order + 1):
        before = np.where(at - k >= start, data[np.maximum(at - k, 0)], END)
        out |= before.astype(np.uint64) << np.uint64(8 * k)
    return out


class Trie:
    """Counts of byte strings of 1 to order + 1 bytes as sorted arrays, one pair for each length."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.tables = tables
        #: For each length: context keys, total, distinct symbols, and of both what a longer context excludes below.
        self.contexts = []
        for k, (keys, counts) in enumerate(tables):
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
            total = np.add.reduceat(counts, first) if len(keys) else counts
            kinds = np.diff(np.append(first, len(keys)))
            out_total, out_kinds = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            if k and len(keys):
                below, found = self._find(k - 1, keys & np.uint64((1 << (8 * k)) - 1))
                out_total = np.add.reduceat(np.where(found, tables[k - 1][1][below], 0), first)
                out_kinds = np.add.reduceat(found.astype(np.int64), first)
            self.contexts.append((context[first], total, kinds, out_total, out_kinds))

    @staticmethod
    def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def _find(self, k: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._at(self.tables[k][0], wanted)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """The log10 probability of the last byte of each (distinct, sorted) string after the bytes before it."""
        n = len(grams)
        out, open_ = np.zeros(n), np.arange(n)
        gone_total, gone_kinds = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(len(self.tables) - 1, -1, -1):
            own = grams[open_] & np.uint64((1 << (8 * (k + 1))) - 1)
            keys, total, kinds, out_total, out_kinds = self.contexts[k]
            where, known = self._at(keys, own >> np.uint64(8))
            at, found = self._find(k, own)
            if len(keys):
                t = np.where(known, total[where] - gone_total[open_], 0)
                d = np.where(known, kinds[where] - gone_kinds[open_], 0)
            else:
                t = d = np.zeros(len(own), np.int64)
            live = known & (d > 0)
            hit = live & found
            counts = self.tables[k][1]
            if hit.any():
                out[open_[hit]] += np.log10(counts[at[hit]] / (t[hit] + d[hit]))
            miss = live & ~found
            out[open_[miss]] += np.log10(d[miss] / (t[miss] + d[miss]))
            if len(keys):
                gone_total[open_] = np.where(known, out_total[where], gone_total[open_] * 0)
                gone_kinds[open_] = np.where(known, out_kinds[where], gone_kinds[open_] * 0)
            open_ = open_[~hit]
        seen = len(self.tables[0][0])
        out[open_] += -np.log10(max(1, 256 - seen))
        return out


def _gather(texts: DataFrame, make, schema: str) -> DataFrame:  # noqa: ANN001
    """key, n: how often the keys that `make` takes from a text array stand in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def send() -> pa.RecordBatch:
            keys, n = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

        for batch in blocks(batches, "text"):
            held.append(np.unique(make(batch["text"]), return_counts=True))
            if sum(len(x) for x, _ in held) > 2 * GATHER:
                held[:] = [merged()]
                if len(held[0][0]) > GATHER:
                    yield send()
        if held:
            yield send()

    return texts.mapInArrow(run, schema).groupBy("key").agg(F.sum("n").alias("n"))


def _most(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The rows with the highest n, at most `most`: keys in order, counts, and the least n that is in."""
    total, least = 0, 1
    for r in table.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        if total + r["count"] > most:
            least = r["n"] + 1
            break
        total += r["count"]
    found = table.where(F.col("n") >= least).select("key", "n").toArrow()
    keys, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order], least


def _level(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the last k + 1 bytes of byte strings."""
    keys, inverse = np.unique(keys & np.uint64((1 << (8 * (k + 1))) - 1), return_inverse=True)
    return keys, np.bincount(inverse, counts, len(keys)).astype(np.int64)


def gram_scores(grams: DataFrame, wanted: DataFrame | None = None, least: int = 1) -> DataFrame:
    """key, value: the log10 probability of the last byte of `wanted` (key), or of the `grams` (key, n) with n >= `least`.

    All counts take part. Contexts of NEAR bytes or more that can matter to a string end in the same NEAR bytes
    as its own, as do the symbols seen there, so a task that gets all strings of these bytes has their part of the trie.
    """
    spark = grams.sparkSession
    short = grams.groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * NEAR)) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    keys, counts = short["key"].to_numpy().view(np.uint64), short["n"].to_numpy()
    above = spark.sparkContext.broadcast([_level(keys, counts, k) for k in range(NEAR)])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(batch[c].to_numpy(zero_copy_only=False) for c in ("key", "n", "asked")) for batch in batches]
        if not held:
            return
        key, n, asked = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        key = key.view(np.uint64)
        trie = Trie([*above.value, *(_level(key[n > 0], n[n > 0], k) for k in range(NEAR, ORDER + 1))])
        found = np.unique(key[asked])
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(trie.log10(found))], ["key", "value"])

    rows = grams.select("key", "n", (F.col("n") >= least if wanted is None else F.lit(False)).alias("asked"))
    if wanted is not None:
        rows = rows.union(wanted.select("key", F.lit(0).cast("long"), F.lit(True)).distinct())
    near = F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * NEAR)) - 1))
    return rows.repartition(task_count(spark), near).mapInArrow(values, "key long, value double")


def ppm_scores(docs: DataFrame, trained: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`, learned from `trained` (text).

    Tokens are words and one end a text. Null texts count as empty: their score is that of the end. Rows are
    told apart by position, so null and repeated ids have their own rows; an empty training table leaves
    uniform bytes and tokens.
    """
    spark = docs.sparkSession
    trained = trained.select(F.col("text").cast("string").alias("text"))
    # The written copy fixes the row numbers that the base score of rare words comes back to.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    grams = cut(_gather(trained, lambda x: strings(*streams(x)), "key long, n long"), "byte-strings")
    frequent = gram_scores(grams, least=_most(grams, NODES)[2]).toArrow()
    order = np.argsort(frequent["key"].to_numpy())
    scores = spark.sparkContext.broadcast((frequent["key"].to_numpy().view(np.uint64)[order], frequent["value"].to_numpy()[order]))
    words = cut(_gather(trained, lambda x: word_hashes(x, lower=True)[0], "key long, n long"), "word-counts")
    ends = trained.count()
    known_tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, vocabulary = known_tokens + ends, kinds + (ends > 0)
    floor = total + 0.1 * (vocabulary + 1)
    common = spark.sparkContext.broadcast(_most(words, WORDS)[:2])
    end_score = float(np.log10((ends + 0.1) / floor))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = common.value
        for batch in blocks(batches, "text"):
            data, sizes = streams(batch["text"])
            distinct, inverse = np.unique(strings(data, sizes), return_inverse=True)
            place, scored = Trie._at(scores.value[0], distinct)
            value = np.zeros(len(distinct))
            value[scored] = scores.value[1][place[scored]]
            starts = np.cumsum(sizes) - sizes
            each = np.add.reduceat(value[inverse], starts)
            left = np.flatnonzero(~scored[inverse])
            open_ = pa.ListArray.from_arrays(np.searchsorted(left, np.append(starts, len(data))).astype(np.int32), pa.array(distinct[inverse[left]].view(np.int64)))
            h, n = word_hashes(batch["text"], lower=True)
            owner = np.repeat(np.arange(len(n)), n)
            at, found = Trie._at(keys, h)
            base = np.full(len(n), end_score)
            known = np.full(len(n), int(ends > 0))
            if found.any():
                base += np.bincount(owner[found], np.log10((counts[at[found]] + 0.1) / floor), len(n))
                known += np.bincount(owner[found], minlength=len(n))
            rare, times = np.unique(np.stack([owner[~found].astype(np.uint64), h[~found]]), axis=1, return_counts=True) if (~found).any() else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
            edges = np.searchsorted(rare[0], np.arange(len(n) + 1).astype(np.uint64)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.view(np.int64))) for x in (rare[1], times)]
            columns = [batch["doc_id"], pa.array(n + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(each), *lists, open_]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base", "score", "rare", "times", "open"])

    schema = "doc_id long, n_tokens long, n_known long, base double, score double, rare array<long>, times array<long>, open array<long>"
    rows = cut(texts.mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    asked = rows.select("row", F.explode(F.arrays_zip(F.col("rare").alias("key"), F.col("times").alias("k"))).alias("x")).select("row", "x.key", "x.k")
    c = F.coalesce("n", F.lit(0))
    answers = asked.join(words.where(F.col("n") > 0), "key", "left").select(
        "row", (F.col("k") * F.log10((c + 0.1) / F.lit(floor))).alias("base_more"), F.when(c > 0, F.col("k")).otherwise(0).alias("seen"), F.lit(0.0).alias("more")
    )
    open_ = rows.select("row", F.explode("open").alias("key"))
    values = open_.join(gram_scores(grams, open_.select("key")), "key").select("row", F.lit(0.0), F.lit(0).cast("long"), "value")
    answers = answers.union(values).groupBy("row").agg(*(F.sum(k).alias(k) for k in ("base_more", "seen", "more")))
    return rows.join(answers, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def ppm_digest(docs: DataFrame) -> DataFrame:
    """Scores of all documents, learned from those that are not held out (one in ten is)."""
    scored = ppm_scores(docs, docs.where(~held_out(10)))
    return scored.select("doc_id", held_out(10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
