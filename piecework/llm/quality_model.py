"""Quality: a generalised additive model with pairwise interactions over dense features of a text.

Each feature is cut into bins; the model is one table of weights for each feature and one for each chosen pair. Tables
are learned by boosting: round by round, feature after feature, a tree of one or two cuts over the feature's bins is
fitted to the gradients of the log loss and a small part of it is added to the feature's table. Then the pairs whose
quarters would still gain most get tables in the same way. A score is the sum of the tables at a text's bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from piecework.llm.common import cut
from piecework.llm.hashing import blocks, join, word_hashes
from piecework.llm.toxicity import held_out

#: Labelled rows that are used at most: those with the least hash of their id.
SAMPLE = 24_000
#: Words that count as common: those in most of the sample's texts.
COMMON = 512
#: Bins of a feature, and of either feature of a pair.
BINS, PAIR_BINS = 48, 12
#: Rounds at most, rounds without a gain on the part kept aside that end them, and the part of a tree that is added.
ROUNDS, PATIENCE, RATE = 400, 25, 0.08
#: Pairs that get a table.
PAIRS = 10
#: Rows that a leaf of a tree needs, and what is added to the curvature of a leaf.
LEAST_ROWS, RIDGE = 12, 1.0
#: Words of a window whose repeats within a text are counted.
WINDOW = 8
#: Score from which a text is predicted good.
GOOD = 0.3

# Classes of bytes of UTF-8. What is in none of these is a letter of another script or a rare sign.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t\x0b\x0c\r", "newline": b"\n",
    "stop": b".,;:", "shout": b"!?", "symbol": b"#*$%&|<>@^~=+_\\/{}", "quote": b"\"'()[]-`",
}
NAMES = [*CLASSES, "other"]
FEATURES = [
    "log_words", "word_bytes", *(f"{n}_share" for n in NAMES if n != "lower"), "line_words", "symbol_ends", "shout_ends", "lone_symbols", "capital_words",
    "long_words", "digit_words", "stop_ends", "common_share", "distinct_share", "repeated_share", "entropy",
]


def _table() -> np.ndarray:
    kinds = np.full(256, len(CLASSES), np.int64)
    for k, signs in enumerate(CLASSES.values()):
        kinds[list(signs)] = k
    return kinds


KINDS = _table()
BLANK, NEWLINE, UPPER, DIGIT, STOP, SHOUT, SYMBOL = (NAMES.index(x) for x in ("blank", "newline", "upper", "digit", "stop", "shout", "symbol"))


def features(texts: pa.Array, common: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text, from its bytes and the hashes of its words; null counts as empty."""
    n = len(texts)
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    kind, text_of = KINDS[data], np.repeat(np.arange(n), sizes)
    of_kind = np.bincount(text_of * len(NAMES) + kind, minlength=n * len(NAMES)).reshape(n, len(NAMES))
    of_byte = np.bincount(text_of * 128 + np.minimum(data, 127), minlength=n * 128).reshape(n, 128)
    # Words: their owner, length, first and last byte.
    inside = (kind != BLANK) & (kind != NEWLINE)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    owner, length, first, last = text_of[a], b - a + 1, kind[a], kind[b]
    words = np.bincount(owner, minlength=n)
    share = lambda mask, of: np.bincount(owner[mask], minlength=n) / np.maximum(of, 1)
    hashes, _ = word_hashes(texts, lower=True)
    known = np.isin(hashes, common)

    def again(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How many keys of each text stand earlier in it too."""
        order = np.lexsort((keys, own))
        same = (keys[order][1:] == keys[order][:-1]) & (own[order][1:] == own[order][:-1])
        return np.bincount(own[order][1:][same], minlength=n)

    runs = hashes
    for step in (1, 2, 4):
        runs = join(runs[:-step], runs[step:]) if len(runs) > step else runs[:0]
    whole = owner[: len(runs)] == owner[len(owner) - len(runs) :]
    total = np.maximum(sizes, 1)
    p = of_byte / total[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    rows = [
        np.log1p(words), np.bincount(owner, length, minlength=n) / np.maximum(words, 1),
        *(of_kind[:, k] / total for k, name in enumerate(NAMES) if name != "lower"), words / (of_kind[:, NEWLINE] + 1),
        share(last == SYMBOL, words), share(last == SHOUT, words), share((length == 1) & (first == SYMBOL), words),
        share((first == UPPER) & (length > 1) & (kind[np.minimum(a + 1, len(kind) - 1)] == UPPER), words) if len(a) else np.zeros(n),
        share(length > 14, words), share(first == DIGIT, words), share(last == STOP, words), share(known, words),
        1 - again(hashes, owner) / np.maximum(words, 1), again(runs[whole], owner[: len(runs)][whole]) / np.maximum(words, 1), entropy,
    ]
    return np.column_stack(rows) if n else np.zeros((0, len(FEATURES)))


def common_words(texts: DataFrame, most: int = COMMON) -> np.ndarray:
    """Hashes of the words that stand in most of `texts`, ties by hash; at most `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            hashes, counts = word_hashes(batch["text"], lower=True)
            owner = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((owner, hashes))
            h, o = hashes[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            keys, n = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["word", "n"])

    counts = texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "word").limit(most).collect()
    return np.sort(np.array([r["word"] for r in found], np.int64).view(np.uint64))


def with_features(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """The rows with a column _features."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            found = features(batch["text"], shared.value)
            column = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "_features"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_features", T.ArrayType(T.DoubleType()))]))


# ---- learning the tables ----


def cuts_of(values: np.ndarray, bins: int) -> np.ndarray:
    """Edges between bins of about as many rows each."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of bins in two, from sums of gradients, curvatures and rows, and its place; 0 if none is allowed."""
    left = np.cumsum(np.stack([g, h, n]), axis=1)
    right = left[:, -1:] - left
    left, right = left[:, :-1], right[:, :-1]
    allowed = (left[2] >= LEAST_ROWS) & (right[2] >= LEAST_ROWS)
    if not allowed.any():
        return 0.0, 0
    gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain = np.where(allowed, gain, 0)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def tree_of(g: np.ndarray, h: np.ndarray, n: np.ndarray, cuts: int = 2) -> np.ndarray:
    """A tree of at most `cuts` cuts over bins: its value at each bin."""
    leaves = [(0, len(g))]
    for _ in range(cuts):
        found = [(*best_cut(g[a:b], h[a:b], n[a:b]), a, b) for a, b in leaves]
        gain, at, a, b = max(found)
        if gain <= 0:
            break
        leaves.remove((a, b))
        leaves += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree over a table of two features' bins that cuts one of them and then the other on either side."""
    best = 0.0, np.zeros(g.shape)
    for turn in (False, True):
        x, y, z = (t.T if turn else t for t in (g, h, n))
        _, at = best_cut(x.sum(axis=1), y.sum(axis=1), z.sum(axis=1))
        out, gain = np.zeros(x.shape), -(x.sum() ** 2) / (y.sum() + RIDGE)
        for rows in (slice(0, at), slice(at, None)) if at else (slice(None),):
            a, b, c = x[rows].sum(axis=0), y[rows].sum(axis=0), z[rows].sum(axis=0)
            _, k = best_cut(a, b, c)
            for columns in (slice(0, k), slice(k, None)) if k else (slice(None),):
                s, t = a[columns].sum(), b[columns].sum()
                out[rows, columns] = s / (t + RIDGE)
                gain += s**2 / (t + RIDGE)
        if gain > best[0]:
            best = gain, out.T if turn else out
    return best


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def loss(label: np.ndarray, score: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, score) - label * score))


@dataclass
class QualityModel:
    """`cuts` and `table` of each feature; `pairs` (i, j, cuts of i, cuts of j, table); all empty without labels to learn from."""

    common: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows of features: one addition a table."""
        out = np.full(len(x), self.base)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cuts, x[:, k], "right")]
        for i, j, one, two, table in self.pairs:
            out += table[np.searchsorted(one, x[:, i], "right"), np.searchsorted(two, x[:, j], "right")]
        return out

    def score(self, docs: DataFrame) -> DataFrame:
        """`docs` with _score, 0 to 1, from the column text; without labels to learn from 0.5."""
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in blocks(batches, "text"):
                score = sigmoid(model.margin(features(batch["text"], model.common)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "_score"])

        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))


def fit_tables(x: np.ndarray, y: np.ndarray, aside: np.ndarray, common: np.ndarray) -> QualityModel:
    """Boosts the tables on the rows that are not kept `aside`; these tell when to stop."""
    fit = ~aside
    rate = np.clip(y[fit].mean(), 1e-3, 1 - 1e-3)
    model = QualityModel(common, float(np.log(rate / (1 - rate))), [cuts_of(x[fit, k], BINS) for k in range(x.shape[1])])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(model.cuts)]
    score = np.full(len(y), model.base)

    def boost(tables: list[np.ndarray], places: list, grow) -> None:  # noqa: ANN001
        """Rounds over all tables, which are left as they were at the least loss on the rows kept aside."""
        nonlocal score
        best, kept, since = loss(y[aside], score[aside]), [t.copy() for t in tables], 0
        for _ in range(ROUNDS):
            for table, at in zip(tables, places, strict=True):
                p = sigmoid(score[fit])
                own = at[fit]
                sums = [np.bincount(own, w, minlength=table.size) for w in (y[fit] - p, p * (1 - p), np.ones(len(p)))]
                step = RATE * grow(*(s.reshape(table.shape) for s in sums))
                table += step
                score += step.ravel()[at]
            now, since = loss(y[aside], score[aside]), since + 1
            if now < best - 1e-6:
                best, kept, since = now, [t.copy() for t in tables], 0
            elif since >= PATIENCE:
                break
        for table, old, at in zip(tables, kept, places, strict=True):
            score += (old - table).ravel()[at]
            table[...] = old

    boost(model.tables, bins, tree_of)
    # Pairs by what a tree over their coarse bins would gain on what the single tables leave.
    coarse = [cuts_of(x[fit, k], PAIR_BINS) for k in range(x.shape[1])]
    wide = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(coarse)]
    p, found = sigmoid(score[fit]), []
    for i, j in combinations(range(x.shape[1]), 2):
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        at = wide[i] * shape[1] + wide[j]
        sums = [np.bincount(at[fit], w, minlength=shape[0] * shape[1]).reshape(shape) for w in (y[fit] - p, p * (1 - p), np.ones(len(p)))]
        found.append((pair_tree(*sums)[0], i, j, at, shape))
    found = sorted(found, key=lambda f: (-f[0], f[1], f[2]))[:PAIRS]
    tables = [np.zeros(shape) for *_, shape in found]
    boost(tables, [at for *_, at, _ in found], lambda *sums: pair_tree(*sums)[1])
    model.pairs = [(i, j, coarse[i], coarse[j], t) for (_, i, j, *_), t in zip(found, tables, strict=True)]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Learns from `docs` (doc_id, text) with `labels` (doc_id, quality); rows without a label or an id are not used."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    # The sample is bounded by `sample`, so it may be broadcast, and its features may come to the driver.
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # Of rows of one id the least text is taken; copies of a text say nothing new, so the least id's label stands for all.
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    once = once.groupBy("text").agg(F.min(F.struct("doc_id", "quality")).alias("x")).select("x.*", "text")
    rows = cut(once, "quality-sample")
    common = common_words(rows)
    found = with_features(rows, common).select("doc_id", "quality", "_features").orderBy("doc_id").collect()
    y = np.array([r["quality"] for r in found], float)
    if len(set(y.tolist())) < 2:
        return QualityModel()
    x = np.array([r["_features"] for r in found])
    # Every fifth row of each label is kept aside.
    aside = np.zeros(len(y), bool)
    for label in (0, 1):
        aside[np.flatnonzero(y == label)[::5]] = True
    return fit_tables(x, y, aside, common)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of `docs`.

    Labels of held-out rows are not read. Null texts count as empty; null ids are scored, never learned from; repeated
    rows are scored alike; without labels of both kinds to learn from every score is 0.5; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = fit_quality(texts, labels.where(~held_out(5))).score(texts)
    return scored.select("doc_id", held_out(5).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= GOOD).cast("int").alias("predicted"))
