"""Operator 13: features by brute force, tables on made problems, held-out rows, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from piecework.llm import quality_model
from piecework.llm import queries as Q
from piecework.llm.hashing import word_hashes
from piecework.llm.quality_model import CLASSES, FEATURES, QualityModel, features, fit_tables, quality_scores, sigmoid

MIDDLE = "/root/testdata/sf0.1"
ODD = [
    (1, "Some words, of prose."), (2, None), (3, ""), (4, "same same"), (4, "same same"), (None, "no id"), (5, "w " * 50_000), (6, " \t\n\x0b\x0c\r "),
    (7, "| a | b ### $$$"), (8, "日本 😀 é"), (9, "x" * 100_000), (10, "LOUD!! WORDS!! a b c d e f g h a b c d e f g h"),
]


def brute_features(text, common):
    data = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n, total = len(words), max(1, len(data))
    kinds = {b: name for name, signs in CLASSES.items() for b in signs}
    of = Counter(kinds.get(b, "other") for b in data)
    kind = lambda b: kinds.get(b, "other")
    share = lambda hit: sum(map(hit, words)) / max(1, n)
    windows = [tuple(w.lower() for w in words[i : i + 8]) for i in range(n - 7)]
    p = [k / total for k in Counter(min(b, 127) for b in data).values()]
    return [
        math.log1p(n), sum(map(len, words)) / max(1, n), *(of[k] / total for k in quality_model.NAMES if k != "lower"), n / (of["newline"] + 1),
        share(lambda w: kind(w[-1]) == "symbol"), share(lambda w: kind(w[-1]) == "shout"), share(lambda w: len(w) == 1 and kind(w[0]) == "symbol"),
        share(lambda w: len(w) > 1 and kind(w[0]) == kind(w[1]) == "upper"), share(lambda w: len(w) > 14), share(lambda w: kind(w[0]) == "digit"),
        share(lambda w: kind(w[-1]) == "stop"), share(lambda w: w.lower() in common),
        1 - (n - len({w.lower() for w in words})) / max(1, n), (len(windows) - len(set(windows))) / max(1, n), -sum(x * math.log2(x) for x in p),
    ]


def test_features_by_brute_force(spark):
    texts = [t or "" for _, t in ODD] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    common = [b"the", b"a", b"of", b"same"]
    hashes = np.sort(word_hashes(pa.array([b" ".join(common).decode()]))[0])
    # As a slice of a larger array too: the offsets then do not begin at 0.
    for array in (pa.array(texts), pa.array(["before", *texts]).slice(1)):
        got = features(array, hashes)
        assert got.shape == (len(texts), len(FEATURES))
        for row, text in zip(got, texts):
            assert row == pytest.approx(brute_features(text, common), abs=1e-9), text[:50]
    assert features(pa.array([], pa.string()), hashes).shape == (0, len(FEATURES))


def test_pairs_learn_what_single_tables_cannot():
    """The label is whether one of two features is high but not both: no table of one feature tells it."""
    rng = np.random.default_rng(5)
    x = rng.random((4_000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.4)).astype(float)
    aside = np.arange(4_000) % 5 == 0
    model = fit_tables(x, y, aside, np.zeros(0, np.uint64))
    right = lambda m: np.mean((m.margin(x[aside]) > 0) == y[aside])
    assert right(model) > 0.97
    model.pairs = []
    assert right(model) < 0.7


def test_scores_are_sums_of_tables():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2_000, 3))
    y = (rng.random(2_000) < sigmoid(2 * np.sin(2 * x[:, 0]) - x[:, 1])).astype(float)
    model = fit_tables(x, y, np.arange(2_000) % 4 == 0, np.zeros(0, np.uint64))
    for row in x[:50]:
        want = model.base + sum(t[sum(c <= v for c in cuts)] for v, cuts, t in zip(row, model.cuts, model.tables))
        want += sum(t[sum(c <= row[i] for c in a), sum(c <= row[j] for c in b)] for i, j, a, b, t in model.pairs)
        assert model.margin(row[None])[0] == pytest.approx(want)
    assert quality_model.loss(y, model.margin(x)) < 0.85 * quality_model.loss(y, np.full(2_000, model.base))


def test_quality_of_held_out_rows(spark):
    rows = Q.QUERIES["op13_quality_scores"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where("held_out").collect()
    good, poor = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in poor]) > 0.98
    assert np.mean([s >= 0.3 for s in good]) > 0.98 and np.mean([s < 0.3 for s in poor]) > 0.9


def test_quality_of_odd_rows(spark):
    frame = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3).select("*", *(F.lit(7).alias(c) for c in "quality score _score _features x word n".split()))
    few = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (7, 1, 0), (10, 0, 0), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    for taught in (few, few.limit(0), few.where("quality = 1")):
        found = quality_scores(frame, taught).collect()
        assert sorted(str(r.doc_id) for r in found) == sorted(str(d) for d, _ in ODD)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
        assert len({r.score for r in found if r.doc_id in (2, 3)}) == 1 and len({r.score for r in found if r.doc_id == 4}) == 1
    assert quality_scores(frame.limit(0), few).count() == 0
    assert {r.score for r in QualityModel().score(frame.select("doc_id", "text")).select(F.col("_score").alias("score")).collect()} == {0.5}


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    other = labels.withColumn("quality", F.when(quality_model.held_out(5), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in quality_scores(docs, x).collect()} for x in (labels, other.withColumn("toxic", F.lit(1))))
    assert one == two
