"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one candidate for each
digest (map-side combined), anti-joined with the index by a sort-merge join that needs no shuffle of the
index, and appended. Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from piecework.llm.common import WHITE, cut, fresh_path, packed, task_count, text_or_empty, unpacked


def normalised(text: str) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(text_or_empty(text), WHITE, "")


#: A digest that more than one in so many rows have is hot; so there are fewer hot digests than this.
HOT = 10_000


class DigestIndex:
    """Digests seen so far, with the id that stands for each, at `path` in a store all executors share.

    `buckets` is fixed when the index is first made; size it so that one bucket's digests fit a task.
    """

    SCHEMA = "digest BINARY, keep_id BIGINT, keep_chars BIGINT"

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + hashlib.md5(path.encode()).hexdigest()[:16]
        where = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({self.SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{where}'"
        )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, candidates: DataFrame) -> None:
        """Adds those of `candidates` (digest, keep_id, keep_chars; one row a digest) that are not there yet.

        One writer at a time: two batches appended at once may both add a digest.
        """
        new = candidates.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        new = new.select("digest", "keep_id", "keep_chars").repartition(self.buckets, "digest")
        # Spark refuses to overwrite what it reads but may append: the anti-join has read the old files only.
        new.write.insertInto(self.table)


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, keep_id, group_size, kept, text_sha256, keep_chars.

    Texts are equal when they are identical without white space. Of equal texts in the batch the row with the
    most code points, then the smallest id stays; a digest that the index already had keeps its earlier id.
    group_size counts the rows of this batch. Null texts count as empty; null ids sort last; an empty batch
    gives an empty result; a row that repeats another's id and text has the same result as that row. Other
    columns of `docs` are not read, so their names cannot clash.
    """
    digests = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"),
            F.length(text_or_empty(text_col)).cast("long").alias("n"),
        ),
        "digests",
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best")
    groups = digests.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size"))
    groups = cut(
        groups.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.n")).alias("keep_chars"), "group_size"),
        "digest-groups",
    )
    index.append(groups)
    classes = cut(groups.select("digest", "group_size").join(index.read().hint("merge"), "digest"), "digest-classes")
    # A digest may hold a third of all rows. Classes of hot digests are fewer than HOT, so they are broadcast and
    # their rows stay where they are; all others are joined by a sort-merge join, in which no digest has many rows.
    hot = F.col("group_size") > digests.count() / HOT
    few = classes.where(hot).select("digest", F.struct("group_size", "keep_id", "keep_chars").alias("class"))
    marked = digests.join(F.broadcast(few), "digest", "left")
    here = marked.where("class IS NOT NULL").select("digest", "doc_id", "n", "class.*")
    rest = marked.where("class IS NULL").drop("class").join(classes.where(~hot).hint("merge"), "digest")
    return here.unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_chars"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "keep_chars",
    )


def fresh_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the session's shared folder."""
    return DigestIndex(spark, fresh_path(spark, "digest-index"), buckets or task_count(spark))


def without_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of `docs` that stay, with the columns of `docs`. Of rows that repeat id and text one stays."""
    kept = exact_dedup(docs, index).where("kept").select("doc_id", "text_sha256").distinct()
    keyed = packed(docs).withColumn("text_sha256", F.sha2(normalised("text"), 256))
    same = [keyed["doc_id"].eqNullSafe(kept["doc_id"]), keyed["text_sha256"] == kept["text_sha256"]]
    return unpacked(keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text_sha256"]), docs)
