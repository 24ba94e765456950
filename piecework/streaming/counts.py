"""Running word counts of a stream of texts, for retraining from time to time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piecework.functions import text as T


def streaming_word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """word, freq of a streaming DataFrame; write it in update or complete mode."""
    return texts.select(F.explode(T.words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
