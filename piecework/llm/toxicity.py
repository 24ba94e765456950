"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The labelled rows are split by a hash in three: the first part gives the lexicon, the second fits the trees, the
third calibrates, so that no part is judged by what it taught. Training and scoring of the trees are Spark ML's.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from piecework.llm.common import cut
from piecework.llm.hashing import blocks

if TYPE_CHECKING:  # Spark ML is imported where the driver uses it: tasks that import this module do without.
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.ml.regression import IsotonicRegressionModel

#: Labelled rows that are used at most: those with the least hash of their id.
SAMPLE = 24_000
#: Terms of the lexicon: at most so many, found in so many toxic texts, with so high a log-odds ratio.
TERMS, LEAST_TEXTS, LEAST_ODDS = 5_000, 4, 2.0
#: Leading letters that are looked up beside the whole word, as insults are inflected.
STEMS = (4, 5)
NEAR = 4
#: Words that a task remembers, and their letters, before it starts anew.
MEMO, LETTERS = 100_000, 4_000_000
# Second-person words of the languages at hand.
SECOND = set("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros su tus".split())
# Digits and signs that stand for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "-": None, "_": None})
_EDGE = ".,;:!?\"'()[]{}<>#*$%&|-_"
_REPEATED = re.compile(r"[!?]{2,}")
_INSIDE = re.compile(r"[^\W\d_][0-9@$!*][^\W\d_]?")
FEATURES = [
    "hits", "hit_share", "hit_weight", "most_weight", "stem_hits", "stem_share", "near_second", "second_share",
    "upper_share", "upper_words", "exclaims", "repeated_marks", "mark_share", "obfuscated", "obfuscated_hits", "log_words",
]


def terms(word: str) -> str:
    """A lower-cased word without marks around it, signs that stand for letters read as such."""
    word = word.strip(_EDGE)
    return word if word.isalpha() else word.translate(_LEET)


class Words(dict):
    """What the features ask of words, by word as it is written, as bits; the upper-case letters stand above these.

    Words are looked at once; when they or their letters are many, it starts anew.
    """

    HIT, STEM, SECOND, ODD, UPPER, BITS = 1, 2, 4, 8, 16, 5

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.letters = lexicon, 0
        self.stems = {x[:-1] for x in lexicon if x.endswith("~")}

    def __missing__(self, raw: str) -> int:
        alpha, word = raw.isalpha(), raw.lower()
        if not alpha:
            word = terms(word)
        code = self.HIT * (word in self.lexicon) | self.SECOND * (word in SECOND)
        if any([word[:k] in self.stems for k in STEMS]):
            code |= self.STEM
        if not alpha and _INSIDE.search(raw):
            code |= self.ODD
        if not raw.islower():
            code |= self.UPPER * raw.isupper() | sum(map(str.isupper, raw)) << self.BITS
        self[raw] = code
        self.letters += len(raw)
        return code

    def of(self, words: list[str]) -> np.ndarray:
        """The bits of `words`, in order."""
        if len(self) > MEMO or self.letters > LETTERS:
            self.clear()
            self.letters = 0
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def features(text: str, known: Words) -> list[float]:
    raw = text.split()
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    bits = known.of(raw)
    hit, stem, second, odd, upper = ((bits & x).astype(bool) for x in (Words.HIT, Words.STEM, Words.SECOND, Words.ODD, Words.UPPER))
    weights = [known.lexicon[terms(raw[i].lower())] for i in np.flatnonzero(hit).tolist()]
    found, at = np.flatnonzero(hit | stem), np.flatnonzero(second)
    near = 0
    if len(found) and len(at):
        k = np.searchsorted(found, at - NEAR)
        near = int(((k < len(found)) & (found[np.minimum(k, len(found) - 1)] <= at + NEAR)).sum())
    marks = sum(map(text.count, "!?*#$%&@"))
    stems = int(stem.sum())
    return [
        math.log1p(len(weights)), len(weights) / n, math.log1p(sum(weights)), max(weights, default=0.0),
        math.log1p(stems), stems / n, math.log1p(near), len(at) / n,
        int((bits >> Words.BITS).sum()) / len(text), int(upper.sum()) / n, text.count("!") / n, len(_REPEATED.findall(text)) / n,
        marks / len(text), int(odd.sum()) / n, math.log1p(int((odd & (hit | stem)).sum())), math.log1p(n),
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float], text_col: str = "text") -> DataFrame:
    """The rows with a column _features; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(shared.value)
        for batch in blocks(batches, text_col):
            found = [features(x.as_py() or "", known) for x in batch[text_col]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names, "_features"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_features", T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(run, schema)


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Terms (words, and stems marked ~) with their log odds of standing in toxic texts; at most TERMS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, toxic = [], []
            for text, label in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
                own = {terms(w) for w in (text.as_py() or "").lower().split()}
                own |= {f"{w[:k]}~" for w in own for k in STEMS if len(w) >= k}
                words += own
                toxic += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], ["term", "toxic"])

    # Copies of a text say nothing new.
    once = labelled.dropDuplicates(["text"])
    bad, all_ = once.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    bad, good = (bad or 0), all_ - (bad or 0)
    counts = once.select("text", "toxic").mapInArrow(run, "term string, toxic int").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    )
    odds = F.log((F.col("a") + 0.5) / (bad - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (good - F.col("b") + 0.5))
    kept = counts.where((F.col("a") >= LEAST_TEXTS) & (F.length("term") > 1)).select("term", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS)
    return {r["term"]: r["odds"] for r in kept.orderBy(F.desc("odds"), "term").limit(TERMS).collect()}


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows with _score, 0 to 1; without labels to learn from it is 0."""
        if self.trees is None:
            return docs.withColumn("_score", F.lit(0.0))
        from pyspark.ml.functions import array_to_vector, vector_to_array

        rows = self.trees.transform(with_features(docs, self.lexicon, text_col).withColumn("_vector", array_to_vector("_features")))
        rows = rows.withColumn("_raw", F.get(vector_to_array("_probability"), F.lit(1)))
        if self.calibration is None:
            return rows.select(*docs.columns, F.col("_raw").alias("_score"))
        # Isotonic steps are flat; a trace of the raw score keeps the order within a step.
        score = F.least(F.greatest(F.col("_calibrated"), F.lit(0.0)), F.lit(1.0)) * 0.998 + F.col("_raw") * 0.002
        return self.calibration.transform(rows).select(*docs.columns, score.alias("_score"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learns from `docs` (doc_id, text) with `labels` (doc_id, toxic); rows without a label or an id are not used."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(20))
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    # The sample is bounded by `sample`, so it may be broadcast.
    chosen = chosen.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = cut(rows.withColumn("part", part), "labelled-sample")
    if rows.where("part >= 9").select("toxic").distinct().count() < 2:
        return ToxicityModel({}, None, None)
    lexicon = learn_lexicon(rows.where("part < 9"))
    judged = with_features(rows.where("part >= 9"), lexicon).select("doc_id", "part", F.col("toxic").cast("double").alias("label"), "_features")
    judged = cut(judged.repartition(4, "doc_id").sortWithinPartitions("doc_id"), "toxicity-features")
    judged = judged.withColumn("_vector", array_to_vector("_features"))
    trees = GBTClassifier(
        featuresCol="_vector", labelCol="label", predictionCol="_predicted",
        maxIter=16, maxDepth=3, maxBins=32, stepSize=0.3, seed=7, checkpointInterval=-1,
    ).fit(judged.where("part < 16"))
    trees = trees.setProbabilityCol("_probability").setRawPredictionCol("_margin")
    rest = trees.transform(judged.where("part >= 16")).withColumn("_raw", F.get(vector_to_array("_probability"), F.lit(1)))
    if rest.isEmpty():
        return ToxicityModel(lexicon, trees, None)
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_calibrated").fit(rest)
    return ToxicityModel(lexicon, trees, calibration)


def held_out(folds: int) -> Column:
    """Whether a row is held out: crc32 of the id as text, modulo `folds`, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of `docs`.

    Labels of held-out rows are not read. Null texts count as empty; null ids are scored, never learned from;
    repeated rows are scored alike; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit_toxicity(texts, labels.where(~held_out(5)))
    scored = model.score(texts)
    return scored.select("doc_id", held_out(5).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
