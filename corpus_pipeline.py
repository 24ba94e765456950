"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's docs.

toxicity drops what it predicts toxic; exact dedup keeps one row of equal texts; n-gram Jaccard join keeps one
document of each group of near copies (the longest, then the smallest id); mixing takes documents as often as
their fitted rates say; best-fit packing places what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piecework.llm.common import cut, documents, labels, packed, text_or_empty, unpacked
from piecework.llm.exact_dedup import fresh_index, without_copies
from piecework.llm.mixing import label_domains, mix, repeats
from piecework.llm.ngram_join import ngram_classes
from piecework.llm.packing import pack_documents
from piecework.llm.queries import vocabulary
from piecework.llm.toxicity import fit_toxicity, held_out

#: Target weights of the mixing stage. Toxic documents are gone by then.
TARGETS = {"good": 0.88, "poor": 0.12}


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text is predicted toxic.

    Null texts count as empty and are scored; null and repeated ids are rows like any other; without labels to
    learn from nothing goes; an empty table stays empty.
    """
    model = fit_toxicity(docs, labels(spark, sf_dir).where(~held_out(5)))
    return unpacked(model.score(packed(docs)).where("_score < 0.5"), docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of texts that are equal without white space: the longest, then the least id, null ids last.

    Null texts count as empty, so one of all blank texts stays; of rows that repeat id and text one stays.
    """
    return without_copies(docs, fresh_index(spark))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the longest, then the least id, null ids last, then any.

    Rows are told apart by a number of their own, so rows of one id, or of none, stay or go each by its text.
    Null and blank texts are near to nothing and stay.
    """
    # A written copy fixes the row numbers.
    rows = cut(packed(docs).withColumn("_number", F.monotonically_increasing_id()), "numbered-rows").withColumnRenamed("_number", "row")
    classes = cut(ngram_classes(rows.select("row", "text"), id_col="row"), "near-classes").withColumnRenamed("doc_id", "row")
    sizes = rows.select("row", F.struct((-F.length(text_or_empty("text"))).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("rank"))
    # Only rows of groups of two or more can go.
    groups = classes.groupBy("component_id").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("component_id")
    grouped = cut(classes.join(groups, "component_id").join(sizes, "row").select("row", "component_id", "rank"), "near-groups")
    best = grouped.groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("row"))
    losers = grouped.select("row").join(best, "row", "left_anti")
    return unpacked(rows.join(losers, "row", "left_anti"), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as its rate says, none or several times, so that expected tokens of domains meet TARGETS.

    Null and blank texts have no tokens and the rate 1 of their posterior's domain mix; null and repeated ids are
    rows like any other (rows of one id are rounded alike); an empty table stays empty.
    """
    domains = label_domains(labels(spark, sf_dir)).where(F.col("domain").isin(list(TARGETS)))
    rated = mix(packed(docs), domains, TARGETS).withColumn("_repeats", repeats()).where("_repeats > 0")
    return unpacked(rated.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_repeats"))), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the pieces of all rows into sequences; rows that mixing took several times are packed as often (see `pack_documents`)."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]
#: Tokenizer, trees and fitted rates have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
