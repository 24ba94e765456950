"""Quality rules: base counts, and the distance of a document's histograms from its language's references.

Only DataFrame functions. The document statistics are computed in one pass over the texts and written; what
follows (references for each language, divergences, verdicts) works on that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piecework.llm.common import cut, text_or_empty

#: Words in a window of the base rule for repeats.
WINDOW = 8
#: Base rule: fewer words fail, and more repeats than this share (in hundredths) of the words.
LEAST_WORDS, MOST_REPEATS = 20, 30
#: Documents with fewer words are not judged by histograms.
GUARD_WORDS = 40
#: With fewer common words, or fewer than its language has, only their share of all words is judged, not which ones they are.
GUARD_COMMON = 20
#: The least distance of a text without common words by which distances of shares are scaled.
LEAST_SCALE = 0.02
#: Other texts a language's reference needs.
LEAST_TEXTS = 10
#: Most Jensen-Shannon divergence (bits, 0 to 1) from the language's reference.
MOST_CLASS_JSD, MOST_WORD_JSD = 0.12, 0.5
#: A word is common if at least one in so many words of its language's distinct texts is that word; so no language has more of them.
COMMON_SHARE = 400
#: Languages with at least one in so many distinct texts stand in for those with too few; so there are no more of them.
LANGUAGE_SHARE = 1_000
#: One character for each common word of a language.
MARKS = "".join(chr(0x100 + k) for k in range(COMMON_SHARE))
#: Character classes: what each counts; the last holds the rest.
CLASSES = ["lower", "upper", "digit", "white", "stop", "symbol", "other"]


# The classes as patterns, but for the last.
PATTERNS = {"upper": "[A-Z]+", "digit": "[0-9]+", "white": r"[\x20\x09-\x0D]+", "stop": r"[.,;:!?'\"()-]+", "symbol": r"[#*$%&|<>]+"}


def bound(x: Column, body) -> Column:
    """`body` of `x`, which is computed once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """A hash of every `window` consecutive words, by doubling: of halves, which `window` must allow."""
    half = window // 2
    of = lambda a, n, step: F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.xxhash64(*(F.get(a, i + k) for k in range(0, n, step))))
    halves = bound(of(words, half, 1), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - half - 1), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + half))))
    return F.when(F.size(words) >= window, halves).otherwise(F.array().cast("array<bigint>"))


def covered_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words that stand in a window found twice or more, from the windows' hashes."""

    def pick(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | (F.get(s, i - 1)["h"] == x["h"]))
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct((i + window).alias("end"), (acc["n"] + i + window - F.greatest(acc["end"], i)).alias("n"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    # The sorted array is bound to a lambda variable, so it is made once. Equal windows are neighbours in it.
    placed = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bound(placed, pick)).otherwise(F.lit(0).cast("long"))


def quality_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, text_hash, the base counts, classes (the histogram of characters) and folded, the words in lower case, joined by spaces."""
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    copies = F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        text_or_empty(text_col).alias("t"),
    )
    rows = rows.select(
        "doc_id",
        "lang",
        F.xxhash64("t").alias("text_hash"),
        F.length("t").cast("long").alias("n"),
        # Lower-case letters go first: the other counts then work on a fraction of the text.
        F.regexp_replace("t", "[a-z]+", "").alias("rest"),
        F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.get(copies, F.lit(0)).cast("long").alias("n_dup_lines"),
    )
    rows = rows.select(
        "*",
        *((F.length("rest") - F.length(F.regexp_replace("rest", x, ""))).cast("long").alias(k) for k, x in PATTERNS.items()),
        window_hashes(F.col("words")).alias("hashes"),
    )
    known = sum((F.col(k) for k in PATTERNS), F.lit(0))
    classes = {"lower": F.col("n") - F.length("rest"), **{k: F.col(k) for k in PATTERNS}, "other": F.length("rest") - known}
    return rows.select(
        "doc_id",
        "lang",
        "text_hash",
        F.size("words").cast("long").alias("n_words"),
        (F.col("n") - F.col("white")).alias("word_chars"),
        F.col("symbol").alias("n_symbols"),
        "n_dup_lines",
        covered_words(F.col("hashes")).alias("n_repeat_words"),
        F.array(*(classes[k].cast("long") for k in CLASSES)).alias("classes"),
        F.lower(F.array_join("words", " ")).alias("folded"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))


def references(statistics: DataFrame) -> DataFrame:
    """For each language the sums over its distinct texts that pass the base rules: lang, texts, class_ref, words, word_ref.

    `words` are the language's common words, the most frequent first; `word_ref` counts them and, last, all others.
    `statistics` must be a written table: its column `row` tells rows apart.
    """
    passed = statistics.where(~base_failed())
    copies = passed.groupBy("lang", "text_hash").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    losers = passed.select("lang", "text_hash", "row").join(copies, ["lang", "text_hash"]).where("row != first").select("row")
    # Written, so that Spark knows their size: few enough are broadcast and the texts stay where they are.
    texts = passed.join(cut(losers, "quality-copies"), "row", "left_anti")
    sums = texts.groupBy("lang").agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum("n_words").alias("total"),
        *(F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES))),
    )
    sums = cut(sums, "quality-languages")
    # Summed before the join, so that a language with most of the words comes as one row a word and task.
    counts = texts.select("lang", F.explode(F.split("folded", " ")).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    common = counts.join(sums.where(F.col("texts") >= LEAST_TEXTS).select("lang", "total"), "lang").where(F.col("n") * COMMON_SHARE >= F.col("total"))
    listed = common.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("listed"))
    found = F.coalesce(F.transform("listed", lambda x: -x["n"]), F.array().cast("array<bigint>"))
    return sums.join(listed, "lang", "left").select(
        "lang",
        "texts",
        F.array(*(f"c{k}" for k in range(len(CLASSES)))).alias("class_ref"),
        F.coalesce(F.transform("listed", lambda x: x["word"]), F.array().cast("array<string>")).alias("words"),
        F.concat(found, F.array(F.col("total") - added(found))).alias("word_ref"),
    )


def added(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def common_counts(folded: Column, words: Column) -> Column:
    """How often each of `words` stands in `folded` and, last, all other words: a found word becomes a character, and lengths count those.

    `folded` holds words joined by spaces, one at least.
    """
    marks = F.transform(words, lambda w, i: F.substring(F.lit(MARKS), i + 1, F.lit(1)))

    def counted(found: Column, coded: Column) -> Column:
        each = F.transform(marks, lambda c: (F.length(coded) - F.length(F.replace(coded, c, F.lit("")))).cast("long"))
        return F.concat(each, F.array((F.size(found) - F.length(coded)).cast("long")))

    coded = lambda found, codes: F.array_join(F.transform(found, lambda w: codes[w]), "")
    of = lambda found, codes: bound(coded(found, codes), lambda x: counted(found, x))
    return bound(F.map_from_arrays(words, marks), lambda codes: bound(F.split(folded, " "), lambda found: of(found, codes)))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two count arrays of equal length; null if either is all zero."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def of(t: Column) -> Column:
        terms = F.zip_with(
            p, q, lambda x, y: part(x / t["p"], (x / t["p"] + y / t["q"]) / 2) + part(y / t["q"], (x / t["p"] + y / t["q"]) / 2)
        )
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2

    sums = F.struct(added(p).alias("p"), added(q).alias("q"))
    return bound(sums, lambda t: F.when((t["p"] > 0) & (t["q"] > 0), of(t)))


def word_distance(p: Column, q: Column) -> Column:
    """How far the words of a text are from a reference, 0 to 1: the greater of two distances.

    One is the divergence of the shares of common and other words, scaled so that a text without common words has
    1; the other is that of the common words among themselves, for texts with enough of them.
    """
    size = F.size(p) - 1
    listed = lambda a: F.slice(a, F.lit(1), size)
    shares = lambda a: F.array(added(listed(a)), F.get(a, size))
    none = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    scaled = divergence(shares(p), shares(q)) / F.greatest(divergence(none, shares(q)), F.lit(LEAST_SCALE))
    enough = added(listed(p)) >= F.greatest(F.lit(GUARD_COMMON), size)
    return F.greatest(F.least(scaled, F.lit(1.0)), F.when(enough, divergence(listed(p), listed(q))))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", refs: DataFrame | None = None) -> DataFrame:
    """One row for each row of `docs`: the base counts, base_failed, class_jsd, word_jsd, kept.

    A document is kept if the base rules pass and neither histogram is further from its language's reference
    than the limit; too short documents are not judged by histograms. `refs` (lang, class_ref, words, word_ref) gives
    references from elsewhere. Without it they are summed over the distinct texts of a language that pass the base
    rules, less the judged text itself, so copies of a text do not move what it is compared with; the common words
    are those that one in COMMON_SHARE words of these texts is. Where fewer than LEAST_TEXTS others are left, the
    nearest of the languages with so many texts, and one in LANGUAGE_SHARE of all, is taken; without any the text is
    not judged. Null texts count as empty (they fail for want of words), null languages are one language of their
    own, other columns are not read.
    """
    stats = quality_statistics(docs, id_col, text_col, lang_col).withColumn("row", F.monotonically_increasing_id())
    stats = cut(stats, "quality-statistics", compression="zstd")
    classes, folded, judged = F.col("classes"), F.col("folded"), F.col("n_words") >= GUARD_WORDS
    # References are one row a language. A language may hold most rows: the join does not shuffle by it unless there
    # are too many languages for Spark's own broadcast limit, and then a large one is split.
    if refs is not None:
        rows = stats.join(refs, "lang", "left")
        class_jsd = divergence(classes, F.col("class_ref"))
        word_jsd = bound(common_counts(folded, F.col("words")), lambda own: word_distance(own, F.col("word_ref")))
    else:
        refs = cut(references(stats), "quality-references")
        large = refs.crossJoin(refs.agg(F.sum("texts").alias("all_texts")))
        large = large.where((F.col("texts") >= LEAST_TEXTS) & (F.col("texts") * LANGUAGE_SHARE >= F.col("all_texts")))
        every = large.agg(F.collect_list(F.struct("lang", "class_ref", "words", "word_ref")).alias("every"))
        rows = stats.join(refs, "lang", "left").crossJoin(F.broadcast(every))
        less = lambda ref, own: F.when(base_failed(), F.col(ref)).otherwise(F.zip_with(ref, own, lambda x, y: x - y))
        others = F.coalesce("texts", F.lit(0)) - F.when(base_failed(), 0).otherwise(1)
        # Its own language has too few others: with this text it may just reach LEAST_TEXTS.
        strange = F.filter("every", lambda r: r["lang"] != F.col("lang"))
        nearest = lambda distance: F.array_min(F.transform(strange, distance))
        class_jsd = F.when(others >= LEAST_TEXTS, divergence(classes, less("class_ref", classes))).otherwise(nearest(lambda r: divergence(classes, r["class_ref"])))
        own_words = bound(common_counts(folded, F.col("words")), lambda own: word_distance(own, less("word_ref", own)))
        other_words = nearest(lambda r: bound(common_counts(folded, r["words"]), lambda own: word_distance(own, r["word_ref"])))
        word_jsd = F.when(others >= LEAST_TEXTS, own_words).otherwise(other_words)
    rows = rows.select(*(c for c in stats.columns if c != "folded"), F.when(judged, class_jsd).alias("class_jsd"), F.when(judged, word_jsd).alias("word_jsd"))
    failed = base_failed()
    near = (F.coalesce("class_jsd", F.lit(0.0)) <= MOST_CLASS_JSD) & (F.coalesce("word_jsd", F.lit(0.0)) <= MOST_WORD_JSD)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & near).alias("kept"), "class_jsd", "word_jsd",
    )
