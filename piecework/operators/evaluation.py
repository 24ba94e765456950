"""Comparing segmentations by the spans of their tokens."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a task compares at a time.
ROWS = 256


def spans(segmented: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end of every token in `tokens`: half-open code point spans."""
    rows = segmented.select(*keys, F.posexplode("tokens").alias("pos", "token"))
    run = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("token")).over(run)
    return rows.select(*keys, (end - F.length("token")).cast("long").alias("start"), end.cast("long").alias("end")).where("end > start")


def f1_matrix(found: DataFrame, doc: str = "doc", method: str = "method") -> DataFrame:
    """pred, true, n_common, f1 for every two methods of a span table; 0 where nothing is shared."""
    sizes = found.groupBy(method).agg(F.count(F.lit(1)).alias("n"))
    shared = found.withColumnRenamed(method, "pred").join(found.withColumnRenamed(method, "true"), [doc, "start", "end"])
    common = shared.groupBy("pred", "true").agg(F.count(F.lit(1)).alias("n_common"))
    # One row a method on either side.
    every = sizes.select(F.col(method).alias("pred"), F.col("n").alias("n_pred"), F.lit(1).alias("one")).join(
        sizes.select(F.col(method).alias("true"), F.col("n").alias("n_true"), F.lit(1).alias("one")), "one"
    )
    both = every.join(common, ["pred", "true"], "left")
    n = F.coalesce("n_common", F.lit(0).cast("long"))
    return both.select("pred", "true", n.alias("n_common"), F.round(2 * n / (F.col("n_pred") + F.col("n_true")), 10).alias("f1"))


def ends_of(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the offset in it at which each token ends, empty tokens left out; a null list has none."""
    import pyarrow.compute as pc

    flat = tokens.flatten()
    sizes = (pc.utf8_length(flat) if pa.types.is_string(flat.type) else flat).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(tokens)), counts)
    ends = np.cumsum(sizes)
    # What the rows before have.
    ends -= np.repeat(np.concatenate([[0], ends])[np.cumsum(counts) - counts], counts)
    return rows[sizes > 0], ends[sizes > 0]


def common_spans(ends: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Spans that every two cuttings of `n` texts share, from bitmaps of their boundaries.

    A span is shared if its two ends are boundaries of both cuttings and neither has a boundary between: neighbours in
    the union of the bitmaps that both stand in the intersection. Each text has two places more, for its begin, which is
    a boundary of all, and for one before it that is only in unions.
    """
    longest = np.zeros(n, np.int64)
    for rows, at in ends:
        np.maximum.at(longest, rows, at)
    begins = np.cumsum(longest + 2) - longest - 1
    bits = np.zeros((len(ends), int((longest + 2).sum())), bool)
    apart = np.zeros(bits.shape[1], bool)
    apart[begins - 1] = True
    for row, (rows, at) in zip(bits, ends, strict=True):
        row[begins] = row[begins[rows] + at] = True
    out = np.diag([len(at) for _, at in ends]).astype(np.int64)
    for i in range(len(ends)):
        for j in range(i):
            both = (bits[i] & bits[j])[bits[i] | bits[j] | apart]
            out[i, j] = out[j, i] = (both[:-1] & both[1:]).sum()
    return out


def f1_of_cuttings(cut: DataFrame, methods: list[str]) -> DataFrame:
    """pred, true, n_common, f1 for every two of the columns `methods` over all rows, tokens or their lengths; 0 where nothing is shared.

    Each row's cuttings meet in the row itself; sums of a batch are all that is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                ends = [ends_of(some[m]) for m in methods]
                shared, sizes = common_spans(ends, some.num_rows), [len(x) for _, x in ends]
                rows = [(a, b, int(shared[i, j]), sizes[i] + sizes[j]) for (i, a), (j, b) in product(enumerate(methods), repeat=2)]
                kinds = pa.string(), pa.string(), pa.int64(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["pred", "true", "n", "sizes"])

    # Tasks get the lengths of tokens, not the tokens.
    lengths = cut.select(*(F.transform(m, F.char_length).alias(m) if isinstance(cut.schema[m].dataType.elementType, T.StringType) else m for m in methods))
    sums = lengths.mapInArrow(run, "pred string, true string, n long, sizes long").groupBy("pred", "true").agg(F.sum("n").alias("n_common"), F.sum("sizes").alias("sizes"))
    return sums.select("pred", "true", "n_common", F.round(F.when(F.col("sizes") > 0, 2 * F.col("n_common") / F.col("sizes")).otherwise(0.0), 10).alias("f1"))


def f1_of_tallies(tallied: DataFrame, methods: list[str]) -> DataFrame:
    """pred, true, n_common, f1 for every two of `methods`, from rows of `common`, the spans that every two share, method by method."""
    n = len(methods)
    # One row, which is read once; none without texts.
    sums = tallied.agg(F.array(*(F.sum(F.get("common", F.lit(k))) for k in range(n * n))).alias("n")).where(F.get("n", F.lit(0)).isNotNull())
    at = lambda k: F.get("n", F.lit(k))
    each = [F.struct(F.lit(a).alias("pred"), F.lit(b).alias("true"), at(i * n + j).alias("n_common"), (at(i * n + i) + at(j * n + j)).alias("sizes")) for (i, a), (j, b) in product(enumerate(methods), repeat=2)]
    rows = sums.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    return rows.select("pred", "true", "n_common", F.round(F.when(F.col("sizes") > 0, 2 * F.col("n_common") / F.col("sizes")).otherwise(0.0), 10).alias("f1"))
