"""Text in, vocabularies in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole files, one row each: path, text; line ends are folded to \\n."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.select("path", F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """JSON lines of token and freq, the most frequent first, ties by rank."""
    vocab.orderBy(F.desc("freq"), "rank").select("token", "freq", "rank").coalesce(1).write.mode("overwrite").json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, freq long, rank long").json(path)


def write_tokens(segmented: DataFrame, path: str) -> None:
    """Text lines of tokens joined by a space."""
    segmented.select(F.array_join("tokens", " ").alias("value")).write.mode("overwrite").text(path)


def write_token_list(vocab: DataFrame, path: str) -> None:
    """Text lines of the tokens alone, in the order they were learned."""
    vocab.orderBy("rank").select(F.col("token").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def without_spaces(texts: DataFrame, text: str = "text") -> DataFrame:
    """Test texts as evaluation takes them: ASCII spaces removed, line breaks kept."""
    return texts.withColumn(text, F.replace(F.col(text), F.lit(" "), F.lit("")))


def corpus_lines(corpus: DataFrame) -> DataFrame:
    """line, w: each distinct segment or word of a trained corpus as its tokens, joined by a space."""
    return corpus.select(F.array_join("tokens", " ").alias("line"), "w")
