"""Soft-membership mixing: document rates whose expected domain token totals match target weights.

A classifier learned from a labelled table gives each document its posterior over the domains. Rates w >= 0 are
then fitted by projected gradient descent on

    1/2 r' H^-1 r + ridge/2 sum_d (n_d / N) (w_d - 1)^2     with r_k = sum_d w_d n_d p_dk / N - t_k

(n_d tokens, N = sum n_d, p_dk posterior, t_k target; H, the posteriors' second moments, puts domains that are
alike on one scale). Steps are taken in the metric of the token counts, so a step needs of the data only the
residual of each domain: one small sum over all documents. The iterate is a function of the residuals so far,
which every task replays; nothing of it is stored or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from piecework.llm.common import cut
from piecework.llm.hashing import blocks

#: Labelled rows that the classifier is fitted on at most: those with the least hash of their id.
SAMPLE = 8_000
#: Features: shares of hashed byte pairs.
WIDTH = 512
RIDGE = 1e-4
STEPS = 100
#: Largest difference of a domain's share from its target at which the fit ends.
CLOSE = 1e-3


def byte_pairs(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs in each text; zeros for texts of under two bytes."""
    out = np.zeros((len(texts), WIDTH))
    for i, text in enumerate(texts):
        b = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
        if len(b) > 1:
            out[i] = np.bincount((b[:-1] * 131 + b[1:] * 31) % WIDTH, minlength=WIDTH)
            out[i] = np.sqrt(out[i] / (len(b) - 1))
    return out


class DomainModel:
    """Posteriors over `domains` from a small matrix of weights; without weights, fixed shares."""

    def __init__(self, domains: list[str], weights: np.ndarray | None, offsets: np.ndarray):
        self.domains, self.weights, self.offsets = domains, weights, offsets

    def posteriors(self, texts: pa.Array) -> np.ndarray:
        z = np.tile(self.offsets, (len(texts), 1)) if self.weights is None else byte_pairs(texts) @ self.weights.T + self.offsets
        z = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        return z / z.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> DomainModel:
    """Learns from `docs` (doc_id, text) and `labelled` (doc_id, domain); rows of other domains are not used."""
    # Imported here: tasks that import this module do without Spark ML.
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    chosen = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    # The sample is bounded by `sample`, so it may be broadcast.
    chosen = chosen.select("doc_id", "domain").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.DoubleType()), T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = [float(domains.index(x)) for x in batch["domain"].to_pylist()]
            columns = [batch["doc_id"], pa.array(label), pa.array(byte_pairs(batch["text"]).tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "features"])

    rows = cut(rows.mapInArrow(run, schema).repartition(4, "doc_id").sortWithinPartitions("doc_id"), "domain-features")
    counts = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return DomainModel(domains, None, np.log(np.array([counts.get(k, 0) + 0.1 for k in range(len(domains))])))
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-4, standardization=False).fit(
        rows.select("label", array_to_vector("features").alias("features"))
    )
    # Domains at the end of the list that no row has get no coefficients of their own.
    weights, offsets = np.zeros((len(domains), WIDTH)), np.full(len(domains), -30.0)
    found = model.coefficientMatrix.toArray()
    weights[: len(found)], offsets[: len(found)] = found, model.interceptVector.toArray()
    return DomainModel(domains, weights, offsets)


def rates(p: np.ndarray, residuals: list[np.ndarray], step: float, ridge: float = RIDGE) -> np.ndarray:
    """The rates after the steps that the (scaled) residuals of each domain gave; accelerated, projected to w >= 0."""
    w = y = np.ones(len(p))
    for k, r in enumerate(residuals):
        new = np.maximum(0.0, y - step * (p @ r + ridge * (y - 1)))
        y = new + k / (k + 3) * (new - w)
        w = new
    return np.maximum(0.0, y)


def fit_rates(posteriors: DataFrame, targets: list[float], ridge: float = RIDGE, steps: int = STEPS) -> list[np.ndarray]:
    """The scaled residuals (see `rates`, with step 1) that fit the rates of `posteriors` (n, p: array of double)."""
    kinds = range(len(targets))
    moments = [F.coalesce(F.sum(F.col("n") * F.get("p", F.lit(i)) * F.get("p", F.lit(j))), F.lit(0.0)) for i in kinds for j in kinds]
    total, *found = posteriors.agg(F.coalesce(F.sum("n"), F.lit(0)), *moments).first()
    t = np.array(targets, float) / sum(targets)
    scale = np.linalg.pinv(np.array(found).reshape(len(t), -1) / max(1, total), rcond=1e-6)
    names = [f"mass{i}" for i in kinds]
    residuals: list[np.ndarray] = []
    while total and len(residuals) < steps:
        so_far = list(residuals)

        def run(batches: Iterator[pa.RecordBatch], so_far: list = so_far) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = batch["p"].flatten().to_numpy().reshape(-1, len(names))
                mass = (rates(p, so_far, 1.0, ridge) * batch["n"].to_numpy()) @ p
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in mass], names)

        # Tasks send a row of one sum a domain, which one task adds up.
        sums = posteriors.select("n", "p").mapInArrow(run, ", ".join(f"{x} double" for x in names)).agg(*(F.sum(x) for x in names)).first()
        share = np.array([x or 0.0 for x in sums]) / total
        if np.abs(share - t).max() < CLOSE:
            break
        residuals.append(scale @ (share - t))
    return residuals


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with _tokens, _posteriors and _rate.

    `labelled` (doc_id, domain) teaches the classifier, `targets` gives the weight of each domain's expected
    tokens (words). Total expected tokens stay those of the corpus. Null and empty texts have no tokens and
    count for nothing; null and repeated ids are rows like any other. A domain with no mass cannot be met; the
    fit is then the nearest in least squares. Empty tables give an empty result.
    """
    domains = list(targets)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit_domains(texts, labelled, domains))

    def posteriors(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
        texts = batch[text_col].cast(pa.string()).fill_null("")
        n = [len(x.as_py().encode("utf-8", "surrogatepass").split()) for x in texts]
        return pa.array(n, pa.int64()), model.value.posteriors(texts)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            n, p = posteriors(batch)
            yield pa.RecordBatch.from_arrays([n, pa.array(p.tolist(), pa.list_(pa.float64()))], ["n", "p"])

    small = cut(docs.select(text_col).mapInArrow(scored, "n long, p array<double>"), "posteriors")
    residuals = fit_rates(small, list(targets.values()))

    # Scored again with the rates in one go: a task then has one Python worker, and posteriors need not travel with texts.
    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            n, p = posteriors(batch)
            more = [n, pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(rates(p, residuals, 1.0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_tokens", "_posteriors", "_rate"])

    more = [T.StructField("_tokens", T.LongType()), T.StructField("_posteriors", T.ArrayType(T.DoubleType())), T.StructField("_rate", T.DoubleType())]
    return docs.mapInArrow(rated, T.StructType([*docs.schema.fields, *more]))


def repeats(rate: str = "_rate", id_col: str = "doc_id") -> Column:
    """How often a document is taken: its rate, rounded up or down by a hash of its id, so that the mean is the rate."""
    chance = F.pmod(F.xxhash64(F.lit("mix"), F.col(id_col)), F.lit(1 << 20)) / float(1 << 20)
    return (F.floor(rate) + (chance < F.col(rate) - F.floor(rate)).cast("int")).cast("int")


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of the labelled table: toxic, poor or good."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).where("domain IS NOT NULL")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float]) -> DataFrame:
    """doc_id, n_tokens, posterior of each domain, rate, repeats."""
    found = mix(docs.select("doc_id", "text"), label_domains(labels), targets)
    each = (F.get("_posteriors", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(targets))
    return found.select("doc_id", F.col("_tokens").alias("n_tokens"), *each, F.col("_rate").alias("rate"), repeats().alias("repeats"))
