"""The engine's functions for SQL: text functions as SQL expressions, segmenters as Arrow functions, cutting as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piecework.functions import text as T
from piecework.operators.segmentation import METHODS, MOST_TOKENS, Cutter, _model


def _literal(text: str) -> str:
    """A SQL string of any characters of the basic plane."""
    return "'" + "".join(f"\\u{ord(c):04X}" for c in text) + "'"


def register_texts(spark: SparkSession) -> list[str]:
    """Temporary SQL functions that Spark inlines: text_normalised, text_segments, text_words, text_characters. Null gives null."""
    normalised = f"translate(t, {_literal(T.DELIMITERS)}, '{'#' * len(T.DELIMITERS)}')"
    made = {
        "text_normalised": ("STRING", normalised),
        "text_segments": ("ARRAY<STRING>", f"filter(split({normalised}, '#'), x -> x <> '')"),
        "text_words": ("ARRAY<STRING>", f"filter(split(t, {_literal('[' + T.WORD_SPACE + ']+')}), x -> x <> '')"),
        "text_characters": ("ARRAY<STRING>", "filter(split(t, ''), x -> x <> '')"),
    }
    for name, (kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    return list(made)


def register_segmenters(spark: SparkSession, vocab: DataFrame) -> list[str]:
    """segment_<method>(text) as arrays of tokens, and the table function cut_text(text, method): pos, token, start, end.

    `vocab` (token, freq) is broadcast within the bound of `segment`. Null texts have no tokens.
    """
    found = _model(vocab, MOST_TOKENS)
    if found is None:
        raise ValueError(f"SQL functions take at most {MOST_TOKENS} tokens; segment() joins larger vocabularies")
    model = spark.sparkContext.broadcast(found)

    def segmenter(method: str):  # noqa: ANN202
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cutter = Cutter(model.value)
            for texts in batches:
                yield pd.Series([cutter.tokens(x or "", method) for x in texts], dtype=object)

        return F.pandas_udf(run, "array<string>")

    for method in METHODS:
        spark.udf.register(f"segment_{method}", segmenter(method))

    class CutText:
        def __init__(self) -> None:
            self.cutter = Cutter(model.value)

        def eval(self, text: str, method: str) -> Iterator[tuple]:
            at = 0
            for pos, token in enumerate(self.cutter.tokens(text or "", method)):
                yield pos, token, at, at + len(token)
                at += len(token)

    spark.udtf.register("cut_text", F.udtf(CutText, returnType="pos int, token string, start int, end int"))
    return [*(f"segment_{m}" for m in METHODS), "cut_text"]
