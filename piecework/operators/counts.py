"""Counts over distinct segments or words with their multiplicity: each text is cut once, each segment counted once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piecework.functions import text as T

PAD, UNK = "<PAD>", "<UNK>"
#: Ranks of literal alphabet entries, above any count.
_PAD, _UNK, _SPECIAL, _INITIAL = 1 << 60, 1 << 59, 1 << 51, 1 << 50
#: Distinct words that a task counts, and characters that it reads, before it passes the counts on. They change no result.
DISTINCT, READ = 600_000, 1 << 26


def weighted_segments(docs: DataFrame, text: str = "text") -> DataFrame:
    """seg, w: the distinct segments between delimiters; null texts have none."""
    return docs.select(F.explode(T.segments(F.col(text))).alias("seg")).groupBy("seg").agg(F.count(F.lit(1)).alias("w"))


def weighted_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, freq. Python's white space is that of `T.WORD_SPACE`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, read = Counter(), 0
        for batch in batches:
            for x in batch["text"]:
                x = x.as_py() or ""
                found.update(x.split())
                read += len(x)
                if len(found) >= DISTINCT or read >= READ:
                    yield from _rows(found)
                    found, read = Counter(), 0
        yield from _rows(found)

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, freq long")
    return counted.groupBy("word").agg(F.sum("freq").alias("freq"))


def _rows(found: Counter, at_once: int = 10_000) -> Iterator[pa.RecordBatch]:
    words, counts = list(found), list(found.values())
    for i in range(0, len(words), at_once):
        yield pa.RecordBatch.from_arrays([pa.array(words[i : i + at_once], pa.string()), pa.array(counts[i : i + at_once], pa.int64())], ["word", "freq"])


def line_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line"))
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("line").alias("n_unique"))


def char_counts(segments: DataFrame) -> DataFrame:
    return segments.select(F.explode(T.chars(F.col("seg"))).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("freq"))


def pair_counts(segments: DataFrame, least: int = 0, tokens: Column | None = None) -> DataFrame:
    """a, b, freq: adjacent pairs, overlapping ones included, kept from `least` on."""
    tokens = T.chars(F.col("seg")) if tokens is None else tokens
    pairs = segments.select(F.explode(T.adjacent(tokens)).alias("p"), "w").groupBy("p.a", "p.b").agg(F.sum("w").alias("freq"))
    return pairs.where(F.col("freq") >= least) if least > 1 else pairs


def alphabet(words: DataFrame, initial: list[str] = (), special: list[str] = (), limit: int = 0) -> DataFrame:
    """id, c: PAD, UNK, specials, initial characters, then characters by count; `limit` + 2 of them if it is set."""
    fixed = {PAD: _PAD, UNK: _UNK} | dict.fromkeys(initial, _INITIAL) | dict.fromkeys(special, _SPECIAL) | {PAD: _PAD, UNK: _UNK}
    spark = words.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0x110000, np.int64)
        for batch in batches:
            found = batch["word"].to_pylist()
            codes = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32)
            np.add.at(sums, codes, np.repeat(batch["freq"].to_numpy(zero_copy_only=False), np.fromiter(map(len, found), np.int64, len(found))))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(map(chr, some.tolist()), pa.string()), pa.array(sums[some])], ["c", "f"])

    whole = words.select("word", F.col("freq").cast("long").alias("freq")).where(F.col("word").isNotNull() & F.col("freq").isNotNull())
    counts = whole.mapInArrow(run, "c string, f long")
    rows = spark.createDataFrame(list(fixed.items()), "c string, f long").union(counts).groupBy("c").agg(F.sum("f").alias("f"))
    # The alphabet is one row a character, so a single ordered partition holds it.
    ids = rows.withColumn("id", F.row_number().over(Window.orderBy(F.desc("f"), "c")).cast("long") - 1).select("id", "c")
    return ids.where(F.col("id") < limit + 2) if limit > 0 else ids


def tagged_ids(words: DataFrame, ids: DataFrame, begin: bool = False, end: bool = False) -> DataFrame:
    """word, freq, ids: each word's character ids (1 if unknown), with bits on its first and last if asked for."""
    at = words.select("word", "freq", F.posexplode(T.chars(F.col("word"))).alias("i", "c")).join(F.broadcast(ids), "c", "left")
    k = F.coalesce("id", F.lit(1).cast("long"))
    if begin:
        k = F.when(F.col("i") == 0, k.bitwiseOR(F.lit(T.BEGIN))).otherwise(k)
    if end:
        k = F.when(F.col("i") == F.length("word") - 1, k.bitwiseOR(F.lit(T.END))).otherwise(k)
    placed = at.select("word", "freq", F.struct("i", k.alias("k")).alias("x")).groupBy("word", "freq").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return placed.select("word", "freq", F.transform("x", lambda x: x["k"]).alias("ids"))
