"""Secret scan: three base patterns, and sliding-window Shannon entropy over candidate strings.

Only DataFrame functions. Positions of matches come from the lengths of what stands between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piecework.llm.common import text_or_empty

# The base kinds in order, as pattern, group that is measured, least code points.
BASE = {
    "assign": (
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
KINDS = [*BASE, "entropy"]
# A run is taken whole by the patterns of one class, so asking for its length in the pattern drops the same matches.
SEARCH = {"assign": BASE["assign"][0], "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

#: Candidate strings of the entropy method, the window, and the least bits a symbol for each character class.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
LEAST_BITS = {"hex": 2.9, "letters and digits": 3.5, "base64": 3.9}
# Candidates that are no secrets. UUIDs, dates, digits only, fillers.
ALLOWED = [
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9/_=+-]+",
    r".*(?:[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Xx]{6}|0123456789|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]).*",
]
# A candidate that consists of these parts alone is joined words: lower-case, capitalised or in capitals, and what joins them.
WORDS = r"[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[/_=+-]++"

_NONE = "array<struct<start:int,end:int,kind:int,found:string,key:string>>"


def _matches(text: Column, kind: int, pattern: str, group: int, least: int, search: str) -> Column:
    """Leftmost, non-overlapping matches as structs with their code point span; failing ones are dropped."""
    whole = F.regexp_extract_all(text, F.lit(search), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(search), F.lit(group)) if group else whole
    rest = F.split(text, search, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["rest"])
        end = begin + F.length(x["whole"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["whole"].alias("found"), x["part"].alias("key"))
        out = F.when(F.length(x["part"]) >= least, F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    pieces = F.filter(
        F.arrays_zip(rest.alias("rest"), whole.alias("whole"), part.alias("part")), lambda x: x["whole"].isNotNull()
    )
    found = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(search), found).otherwise(F.array().cast(_NONE))


def _term(count: Column) -> Column:
    """c * log2(c), 0 for 0."""
    return F.when(count > 0, count * F.log2(F.greatest(count, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits a symbol) of any `window` consecutive characters of a string.

    The counts of a window follow from those of the one before: one character comes in, one goes out, and the
    sum of c*log2(c) changes by the terms of these two only. Strings shorter than the window give null.
    """
    chars = F.split(candidate, "")

    def over(x: Column) -> Column:
        counts = F.transform(x["symbols"], lambda _: F.lit(0))
        start = F.struct(counts.alias("counts"), F.lit(0.0).cast("double").alias("sum"), F.lit(1e9).cast("double").alias("least"))

        def step(acc: Column, i: Column) -> Column:
            come = F.array_position(x["symbols"], F.get(x["chars"], i)).cast("int") - 1
            gone = F.when(i >= window, F.array_position(x["symbols"], F.get(x["chars"], i - window)).cast("int") - 1).otherwise(F.lit(-1))
            a = F.get(acc["counts"], come)
            added = _term(a + 1) - _term(a)
            b = F.coalesce(F.get(acc["counts"], gone), F.lit(0))
            total = F.when((gone < 0) | (gone == come), acc["sum"] + F.when(gone == come, 0.0).otherwise(added)).otherwise(
                acc["sum"] + added + _term(b - 1) - _term(b)
            )
            counts = F.transform(
                acc["counts"], lambda c, k: c + F.when(k == come, 1).otherwise(0) - F.when(k == gone, 1).otherwise(0)
            )
            least = F.when(i >= window - 1, F.least(acc["least"], total)).otherwise(acc["least"])
            return F.struct(counts.alias("counts"), total.alias("sum"), least.alias("least"))

        done = F.aggregate(F.sequence(F.lit(0), F.size(x["chars"]) - 1), start, step, lambda acc: acc["least"])
        return F.log2(F.lit(float(window))) - done / window

    once = F.transform(F.array(F.struct(chars.alias("chars"), F.array_distinct(chars).alias("symbols"))), over)
    return F.when(F.length(candidate) >= window, F.get(once, F.lit(0)))


def _high(found: Column) -> Column:
    """Whether a candidate string is dense enough for its class and on no allow-list."""
    bits = window_entropy(found)
    least = (
        F.when(found.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), LEAST_BITS["hex"])
        .when(found.rlike(r"^[A-Za-z0-9]+$"), LEAST_BITS["letters and digits"])
        .otherwise(LEAST_BITS["base64"])
    )
    allowed = found.rlike("^(?:" + "|".join(ALLOWED) + ")$") | (F.regexp_replace(found, WORDS, "") == "")
    return F.when(allowed, F.lit(False)).otherwise(bits >= least)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, base and added, arrays of (start, end, kind, found, key).

    kind counts KINDS; spans are code points, end exclusive. Base spans come kind by kind; `added` holds
    candidate strings of high entropy that touch no base span. Null texts count as empty and have no spans;
    repeated rows each get a row, an empty table gives none; other columns are not read.
    """
    text = F.col("_text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_text"))
    base = [_matches(text, k, *BASE[kind], SEARCH[kind]) for k, kind in enumerate(BASE)]
    wide = r"(?<![A-Za-z0-9+/_=-])" + CANDIDATE
    added = _matches(text, len(BASE), wide, 0, WINDOW, wide)
    rows = rows.select("doc_id", F.concat(*base).alias("base"), added.alias("candidates"))
    clear = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    high = F.filter("candidates", lambda x: clear(x) & _high(x["found"]))
    return rows.select("doc_id", "base", F.when(F.size("candidates") > 0, high).otherwise(F.array().cast(_NONE)).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    rows = secret_spans(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
