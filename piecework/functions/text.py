"""Scalar text functions of the subword engine, as column expressions. The unit is the Unicode code point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 40 delimiters, and the 29 code points that separate words.
DELIMITERS = " 。，？！；：、（）「」“”‘’《》【】…—～.,?!;:()\"'<>[]~\n\t"
WORD_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
BEGIN, END = 1 << 31, 1 << 30


def char_class(chars: str, negated: bool = False) -> str:
    """A regular expression class of exactly these characters, for Java and RE2."""
    return "[" + "^" * negated + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


def normalised(text: Column) -> Column:
    """Every delimiter becomes one #; a # of the text delimits too."""
    return F.translate(text, DELIMITERS, "#" * len(DELIMITERS))


def segments(text: Column) -> Column:
    return F.filter(F.split(normalised(text), "#"), lambda x: x != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, char_class(WORD_SPACE) + "+"), lambda x: x != "")


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def adjacent(tokens: Column) -> Column:
    """Structs (a, b) of neighbours in an array."""
    both = lambda t: F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    once = F.get(F.transform(F.array(tokens), both), F.lit(0))
    return F.when(F.size(tokens) > 1, once).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def with_delimiters(text: Column) -> Column:
    """Cut at delimiters, which stay as tokens of their own."""
    return F.regexp_extract_all(text, F.lit(f"{char_class(DELIMITERS, True)}+|{char_class(DELIMITERS)}"), F.lit(0))


def joined_pieces(line: Column, joiner: str = "@@ ") -> Column:
    """The pieces of a line whose pieces a joiner marks, cut at delimiters as well."""
    return F.flatten(F.transform(F.split(line, joiner), with_delimiters))


def single_count(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda x: F.length(x) == 1))


def display(raw: Column, identifier: Column, prefix: str = "", suffix: str = "") -> Column:
    """A tagged token as shown: the prefix unless it begins a word, the suffix if it ends one."""
    begin = identifier.bitwiseAND(F.lit(BEGIN)) != 0
    end = identifier.bitwiseAND(F.lit(END)) != 0
    shown = F.concat(F.when(begin, "").otherwise(F.lit(prefix)), raw, F.when(end, F.lit(suffix)).otherwise(""))
    return F.when(identifier == 0, "<PAD>").when(identifier == 1, "<UNK>").otherwise(shown)
