"""Segmenting text with a vocabulary (token, freq): longest match either way, both, and by merges; ids of words and back.

A vocabulary of at most MOST_TOKENS is broadcast. A larger one stays a table: the distinct runs of the texts are looked up
in it by joins, and each text is cut by the tokens that stand in it, which gives the same tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from piecework.functions import text as X
from piecework.operators.merging import merge_by_rank, merge_in_order
from piecework.operators.store import Written
from piecework.operators.training import WordModel

#: The largest vocabulary that is broadcast; about 100 bytes a token.
MOST_TOKENS = 1_000_000
#: Distinct runs a task remembers before it starts anew, and the longest that it remembers.
MEMO, LONG = 100_000, 200
#: Rows of tokens that a task puts characters back into at a time.
FILLED = 64
#: A vocabulary of so many tokens, none longer, is cut by regular expressions.
FEW, LONGEST = 2_000, 40
#: Texts that a task counts at a time.
ROWS = 256
#: Rows of a batch that tasks send, and parts that each token and run of a join is dealt to.
SENT, PARTS = 50_000, 8


class Trie:
    """Longest matches of tokens in one walk: the time goes by the characters that match, not by the longest token."""

    END = ""

    def __init__(self, tokens: Iterable[str]):
        self.root: dict = {}
        for token in tokens:
            node = self.root
            for c in token:
                node = node.setdefault(c, {})
            node[self.END] = True

    def longest(self, text: str, at: int) -> int:
        """Length of the longest token that begins at `at`; 1 if none does."""
        node, best = self.root, at + 1
        for k in range(at, len(text)):
            node = node.get(text[k])
            if node is None:
                break
            if self.END in node:
                best = k + 1
        return max(best - at, 1)

    def cut(self, text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            size = self.longest(text, at)
            out.append(text[at : at + size])
            at += size
        return out


def trie_pattern(tokens: Iterable[str]) -> re.Pattern:
    """Matches the longest token that begins at a place, or else one character."""
    trie = Trie(t for t in tokens if t)

    def branch(node: dict) -> str:
        ways = [re.escape(c) + (branch(below) if set(below) != {Trie.END} else "") for c, below in node.items() if c != Trie.END]
        return f"(?:{'|'.join(ways)}){'?' if Trie.END in node else ''}"

    return re.compile(f"{branch(trie.root)}|." if trie.root else ".", re.DOTALL)


def merge_ranks(vocab: dict[str, int]) -> dict[tuple[str, str], tuple[int, str]]:
    """The pairs that `by_merges` joins, with their rank and token; parts are characters or tokens themselves."""
    part = lambda t: len(t) == 1 or t in vocab
    pairs = [(-n, t[:k], t[k:]) for t, n in vocab.items() for k in range(1, len(t)) if part(t[:k]) and part(t[k:])]
    return {(a, b): (k, a + b) for k, (_, a, b) in enumerate(sorted(pairs))}


def by_merges(text: str, vocab: dict[str, int]) -> list[str]:
    """Joins, again and again, the neighbours whose concatenation is the most frequent token; equal neighbours from the right."""

    def rank(a: str, b: str) -> tuple | None:
        freq = vocab.get(a + b)
        return None if freq is None else (-freq, a, b)

    return merge_by_rank(list(text), rank, str.__add__, True)


WAYS = ["forward", "backward", "merges"]
METHODS = [*WAYS, "bidirectional"]


def run_pattern(letters: Iterable[str]) -> re.Pattern:
    """Matches runs of `letters`, the characters that tokens of two and more have, and any other character on its own."""
    some = "".join(sorted(map(re.escape, letters)))
    return re.compile(f"[{some}]+|." if some else ".", re.DOTALL)


class Cutter:
    """Cuts texts by a vocabulary. No token reaches over a character that no longer token has, so the runs between
    such characters are cut on their own, and each distinct run once as long as it is remembered."""

    def __init__(self, vocab: dict[str, int], runs: re.Pattern | None = None):
        self.vocab, self.tries = vocab, {}
        #: Whether the vocabulary is cut by patterns and ranks that are made beforehand.
        self.few = 0 < len(vocab) <= FEW and max(map(len, vocab)) <= LONGEST
        self.ranks = merge_ranks(vocab) if self.few else {}
        self.runs = runs or run_pattern({c for t in vocab if len(t) > 1 for c in t})
        self.known: dict[str, dict[str, list[str]]] = {k: {} for k in WAYS}

    def trie(self, back: bool) -> Trie:
        """The tokens, or the tokens read backward; made when first asked for."""
        if back not in self.tries:
            self.tries[back] = Trie(t[::-1] if back else t for t in self.vocab)
        return self.tries[back]

    def pattern(self, back: bool) -> re.Pattern:
        if (back, "pattern") not in self.tries:
            self.tries[back, "pattern"] = trie_pattern(t[::-1] if back else t for t in self.vocab)
        return self.tries[back, "pattern"]

    def run(self, run: str, way: str) -> list[str]:
        if way == "merges":
            return merge_in_order(list(run), self.ranks, True) if self.few else by_merges(run, self.vocab)
        if self.few:
            found = self.pattern(way == "backward").findall(run[::-1] if way == "backward" else run)
            return found if way == "forward" else [t[::-1] for t in found[::-1]]
        if way == "forward":
            return self.trie(False).cut(run)
        return [t[::-1] for t in self.trie(True).cut(run[::-1])[::-1]]

    def cut(self, text: str, way: str) -> list[str]:
        known, out = self.known[way], []
        for run in self.runs.findall(text):
            if len(run) == 1:
                out.append(run)
            elif (found := known.get(run)) is not None:
                out += found
            else:
                found = self.run(run, way)
                if len(run) <= LONG:
                    if len(known) >= MEMO:
                        known.clear()
                    known[run] = found
                out += found
        return out

    def bidirectional(self, text: str) -> list[str]:
        """Line by line the way with fewer tokens, then fewer single characters, else backward; line breaks are tokens."""
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            cost = lambda x: (len(x), sum(len(t) == 1 for t in x))
            one, two = self.cut(line, "forward"), self.cut(line, "backward")
            out += ["\n"] * (i > 0) + (one if cost(one) < cost(two) else two)
        return out

    def tokens(self, text: str, method: str) -> list[str]:
        return self.bidirectional(text) if method == "bidirectional" else self.cut(text, method)


class Tallies:
    """Counts of the cuttings of whole blocks of texts, from bitmaps of the places where tokens end."""

    def __init__(self, vocab: dict[str, int]):
        longer = {t: n for t, n in vocab.items() if len(t) > 1}
        self.patterns = [trie_pattern(longer), trie_pattern(t[::-1] for t in longer)]
        letters = sorted({c for t in longer for c in t})
        number = {t: k for k, t in enumerate([*letters, *longer], 1)}
        # 0 are all characters that no longer token has.
        self.letters = np.zeros(0x110000, np.int32)
        self.letters[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        size = len(number) + 1
        self.none = len(longer) * LONGEST + 1
        self.rank = np.full((size, size), self.none, np.int32)
        self.made = np.zeros((size, size), np.int32)
        for (x, y), (k, t) in merge_ranks(longer).items():
            self.rank[number[x], number[y]], self.made[number[x], number[y]] = k, number[t]
        #: Characters that stand side by side in some token; no token reaches between others.
        self.beside = np.zeros((len(letters) + 1,) * 2, bool)
        for t in longer:
            for x, y in zip(t, t[1:], strict=False):
                self.beside[number[x], number[y]] = True

    def longest(self, text: str, back: bool) -> np.ndarray:
        sizes = np.fromiter(map(len, self.patterns[back].findall(text[::-1] if back else text)), np.int64)
        out = np.zeros(len(text), bool)
        out[np.cumsum(sizes[::-1] if back else sizes) - 1] = True
        return out

    def merged(self, codes: np.ndarray) -> np.ndarray:
        """Where tokens end after all merges: each piece between which no token reaches has its best pair merged, again and again."""
        tokens, out = self.letters[codes], np.ones(len(codes), bool)
        together = np.append(self.beside[tokens[:-1], tokens[1:]], False)
        # Only pieces of two characters and more.
        some = together | np.concatenate([[False], together[:-1]])
        place, tokens = np.flatnonzero(some), tokens[some]
        piece = np.cumsum(np.concatenate([[True], ~together[:-1]]))[some]
        while len(tokens):
            rank = np.append(self.rank[tokens[:-1], tokens[1:]], self.none)
            rank[:-1][piece[:-1] != piece[1:]] = self.none
            heads = np.flatnonzero(np.diff(piece, prepend=-1))
            counts = np.diff(np.append(heads, len(piece)))
            best = np.repeat(np.minimum.reduceat(rank, heads), counts)
            live = best < self.none
            if not live.all():
                tokens, place, piece, rank, best = (x[live] for x in (tokens, place, piece, rank, best))
                if not len(tokens):
                    break
            hits = np.flatnonzero(rank == best)
            # Neighbouring hits are equal neighbours: every second one, from the right.
            last = np.flatnonzero(np.append(np.diff(hits) != 1, True))
            after = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(hits))
            hits = hits[after % 2 == 0]
            tokens[hits] = self.made[tokens[hits], tokens[hits + 1]]
            # `place` is where a token begins.
            out[place[hits + 1] - 1] = False
            keep = np.ones(len(tokens), bool)
            keep[hits + 1] = False
            tokens, place, piece = tokens[keep], place[keep], piece[keep]
        return out

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text: tokens and single characters of each of METHODS; spans that METHODS share, one by one with each."""
        heads = np.cumsum([0, *(x.count("\n") + 1 for x in texts)])
        # No token reaches over the line breaks that end all lines.
        joined = "\n".join([*texts, ""])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = [self.longest(joined, False), self.longest(joined, True), self.merged(codes)]
        last = np.flatnonzero(codes == ord("\n"))
        sums = lambda x: np.diff(np.cumsum(x)[last], prepend=0)

        def shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
            """A span is shared if both have its ends, which neighbour in the union of the two."""
            some = np.flatnonzero(one | two)
            both = (one & two)[some]
            out = np.zeros(len(one), bool)
            out[some] = both & np.concatenate([[True], both[:-1]])
            return sums(out)

        n = np.stack([sums(x) for x in ends], axis=1)
        single = np.stack([sums(x & np.concatenate([[True], x[:-1]])) for x in ends], axis=1)
        common = np.zeros((len(last), len(METHODS), len(METHODS)), np.int64)
        for i, one in enumerate(ends):
            common[:, i, i] = n[:, i]
            for j in range(i):
                common[:, i, j] = common[:, j, i] = shared(one, ends[j])
        # By line the way with fewer tokens, then fewer single characters, else backward.
        way = np.where((n[:, 0] < n[:, 1]) | ((n[:, 0] == n[:, 1]) & (single[:, 0] < single[:, 1])), 0, 1)
        row = np.arange(len(last))
        common[:, 3, :3] = common[:, :3, 3] = common[row, way, :3]
        common[:, 3, 3] = n[row, way]
        sizes = np.stack([np.column_stack([x, x[row, way]]) for x in (n, single)], axis=2)
        # The line break that was put after each text is a token of one character in every way.
        return np.add.reduceat(sizes, heads[:-1], axis=0) - 1, np.add.reduceat(common, heads[:-1], axis=0) - 1


def tally_all(docs: DataFrame, vocab: DataFrame, keys: list[str], text: str = "text", most: int = MOST_TOKENS) -> DataFrame | None:
    """keys and `sizes`, for each of METHODS its numbers of tokens and of single characters, and `common`, for every two of
    METHODS the spans they share, both as flat arrays: what counts of `segment_all` give, without making the tokens.

    None if the vocabulary has more than FEW tokens, long ones, or tokens over line breaks: these are cut by `segment_all`.
    """
    vocabulary = _model(vocab, min(most, FEW))
    if vocabulary is None or any(len(t) > LONGEST or "\n" in t for t in vocabulary if len(t) > 1) or len({c for t in vocabulary for c in t}) > FEW:
        return None
    model = docs.sparkSession.sparkContext.broadcast(vocabulary)
    chosen = docs.select(*keys, F.col(text).alias("_text"))
    numbers = T.ArrayType(T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = Tallies(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                found = tallies.texts([x or "" for x in rows["_text"].to_pylist()])
                lists = [pa.array(list(x.reshape(len(x), -1)), pa.list_(pa.int64())) for x in found]
                yield pa.RecordBatch.from_arrays([*(rows[k] for k in keys), *lists], [*keys, "sizes", "common"])

    fields = [chosen.schema[k] for k in keys]
    return chosen.mapInArrow(run, T.StructType([*fields, T.StructField("sizes", numbers), T.StructField("common", numbers)]))


def _model(vocab: DataFrame, most: int) -> dict[str, int] | None:
    """The vocabulary on the driver; None if it has more than `most` tokens."""
    rows = vocab.select("token", "freq").limit(most + 1).collect()
    return {r["token"]: r["freq"] for r in rows} if len(rows) <= most else None


def _letters(vocab: DataFrame) -> re.Pattern:
    """The pattern of runs; each character comes to the driver once, so they are as few as Unicode has."""
    return run_pattern(r[0] for r in vocab.where(F.length("token") > 1).select(F.explode(X.chars(F.col("token")))).distinct().toLocalIterator())


def held_tokens(texts: DataFrame, vocab: DataFrame, pattern: re.Pattern) -> DataFrame:
    """at, held: for each of `texts` (at, text) in which tokens of two characters or more stand these tokens (token, freq).

    Tokens of one character change no cut. The parts of each distinct run that are as long as some token are joined with
    the vocabulary, and the tokens found go back to the texts that have the run. Runs and tokens that most texts have are
    dealt to PARTS, by the numbers of the other side.
    """
    longer = vocab.where(F.length("token") > 1).select("token", "freq")
    # One row for each length.
    sizes = sorted(r[0] for r in longer.select(F.length("token")).distinct().toLocalIterator())

    def sent(pairs: Iterator[tuple[int, str]], names: list[str]) -> Iterator[pa.RecordBatch]:
        while some := list(islice(pairs, SENT)):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*some, strict=True), (pa.int64(), pa.string()), strict=True)], names)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((at, x.as_py()) for batch in batches for at, x in zip(batch["at"].to_pylist(), batch["text"], strict=True))
        yield from sent(((at, run) for at, x in each for run in {r for r in pattern.findall(x or "") if len(r) > 1}), ["at", "run"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((n, x.as_py()) for batch in batches for n, x in zip(batch["id"].to_pylist(), batch["run"], strict=True))
        # A set of the parts of one length has at most as many as the run has characters.
        yield from sent(((n, t) for n, x in each for k in sizes if k <= len(x) for t in {x[i : i + k] for i in range(len(x) - k + 1)}), ["id", "token"])

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))

    part = lambda c: F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int").alias("part")
    placed = Written(texts.mapInArrow(runs, "at long, run string"), "runs").table
    # A written copy fixes the numbers.
    distinct = Written(placed.select("run").distinct().select(F.monotonically_increasing_id().alias("id"), "run"), "distinct-runs").table
    found = distinct.mapInArrow(parts, "id long, token string").select("*", part("id")).join(dealt(longer), ["token", "part"])
    found = found.groupBy("id").agg(F.collect_list(F.struct("token", "freq")).alias("held")).join(distinct, "id").select("run", "held")
    found = placed.select("*", part("at")).join(dealt(found), ["run", "part"])
    return found.groupBy("at").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))


def _with_cuts(docs: DataFrame, vocab: DataFrame, methods: dict[str, str], text: str, most: int) -> DataFrame:
    """`docs` with a column of tokens for each of `methods` (column to method)."""
    kinds = [T.StructField(name, T.ArrayType(T.StringType())) for name in methods]
    schema = T.StructType([*docs.schema.fields, *kinds])
    vocabulary = _model(vocab, most)
    if vocabulary is not None:
        model = docs.sparkSession.sparkContext.broadcast(vocabulary)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cutter = Cutter(model.value)
            for batch in batches:
                texts = [x.as_py() or "" for x in batch[text]]
                tokens = [pa.array([cutter.tokens(x, m) for x in texts], pa.list_(pa.string())) for m in methods.values()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *tokens], [*batch.schema.names, *methods])

        return docs.mapInArrow(run, schema)

    pattern = _letters(vocab)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("text"))
    rows = Written(whole.withColumn("at", F.monotonically_increasing_id()), "numbered-texts").table
    joined = rows.join(held_tokens(rows.select("at", "text"), vocab, pattern), "at", "left").select("row", "text", "held")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[list[str]]] = [[] for _ in methods]
            for x, tokens in zip(batch["text"], batch["held"], strict=True):
                cutter = Cutter({t["token"]: t["freq"] for t in tokens.as_py() or []}, pattern)
                for out, m in zip(found, methods.values(), strict=True):
                    out.append(cutter.tokens(x.as_py() or "", m))
            yield pa.RecordBatch.from_arrays([batch["row"], *(pa.array(x, pa.list_(pa.string())) for x in found)], ["row", *methods])

    return joined.mapInArrow(cut, T.StructType([rows.schema["row"], *kinds])).select("row.*", *methods)


def segment(docs: DataFrame, vocab: DataFrame, method: str, text: str = "text", most: int = MOST_TOKENS) -> DataFrame:
    """`docs` with `tokens`; null texts have none. `method` is one of METHODS; `vocab` has each token once.

    A vocabulary of more than `most` tokens is joined, not broadcast; the tokens are the same.
    """
    return _with_cuts(docs, vocab, {"tokens": method}, text, most)


def segment_all(docs: DataFrame, vocab: DataFrame, keys: list[str], text: str = "text", most: int = MOST_TOKENS) -> DataFrame:
    """keys and a column of tokens for each of METHODS: the texts are read once and cut in every way (see `segment`)."""
    found = _with_cuts(docs.select(*keys, F.col(text).alias("_text")), vocab, {m: m for m in METHODS}, "_text", most)
    return found.select(*keys, *METHODS)


def encode_words(words: DataFrame, merges: list[tuple[str, str, int]]) -> DataFrame:
    """word, tokens: the merges applied in the order they were learned, to each distinct word, from the left."""
    ranks = words.sparkSession.sparkContext.broadcast({(a, b): (k, a + b) for k, (a, b, _) in enumerate(merges)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [merge_in_order(list(x or ""), ranks.value, False) for x in batch["word"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["word"], pa.array(tokens, pa.list_(pa.string()))], ["word", "tokens"])

    return words.select("word").mapInArrow(run, "word string, tokens array<string>")


def encode_ids(words: DataFrame, model: WordModel) -> DataFrame:
    """word, ids: the model ids of each word; characters that the model lacks are -1."""
    spark = words.sparkSession
    letters = {r["c"]: r["id"] for r in model.alphabet.collect()}
    base = {r["tagged"]: r["id"] for r in model.base.collect()}
    merges = {(r["x"], r["y"]): (r["rank"], r["new"]) for r in model.merges.collect()}
    begin, end = model.options.continuing_subword_prefix != "", model.options.end_of_word_suffix != ""
    shared = spark.sparkContext.broadcast((letters, base, merges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, base, merges = shared.value
        for batch in batches:
            found = []
            for x in batch["word"]:
                word = x.as_py() or ""
                tags = [(X.BEGIN if begin and i == 0 else 0) | (X.END if end and i == len(word) - 1 else 0) for i in range(len(word))]
                ids = [base.get(letters[c] | t, -1) if c in letters else -1 for c, t in zip(word, tags, strict=True)]
                found.append(merge_in_order(ids, merges, False))
            yield pa.RecordBatch.from_arrays([batch["word"], pa.array(found, pa.list_(pa.int64()))], ["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<bigint>")


def decode_ids(encoded: DataFrame, model: WordModel) -> DataFrame:
    """`encoded` with `text`: the tokens of `ids` joined, prefixes and suffixes taken off; unknown ids show as <UNK>."""
    prefix, suffix = model.options.continuing_subword_prefix, model.options.end_of_word_suffix
    tokens = encoded.sparkSession.sparkContext.broadcast({r["id"]: r["token"] for r in model.vocab.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids in batch["ids"].to_pylist():
                shown = [tokens.value.get(i, "<UNK>") for i in ids or []]
                shown = [t.removeprefix(prefix) if k else t for k, t in enumerate(shown)]
                texts.append("".join(t.removesuffix(suffix) if k == len(shown) - 1 else t for k, t in enumerate(shown)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))


def known_characters(tokens: list[str], text: str, unknown: str = "<UNK>") -> list[str]:
    """Tokens of another tool with each unknown one replaced by the character of the text that stands there."""
    out, at = [], 0
    for t in tokens:
        out.append(text[at : at + 1] if t == unknown else t)
        at += 1 if t == unknown else len(t)
    return out


def with_known_characters(rows: DataFrame, tokens: str = "tokens", text: str = "text", unknown: str = "<UNK>") -> DataFrame:
    """`rows` with unknown tokens of the array `tokens` replaced by the characters of `text`, at a running offset.

    An unknown token stands for one character, and tokens leave nothing out; past the end it becomes an empty string. Null
    tokens stay null, a null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index(tokens)
            # A few rows at a time are Python objects.
            for k in range(0, whole.num_rows, FILLED):
                batch = whole.slice(k, FILLED)
                pairs = zip(batch[tokens], batch[text], strict=True)
                found = [None if not t.is_valid else known_characters(t.as_py(), x.as_py() or "", unknown) for t, x in pairs]
                yield batch.set_column(at, batch.schema.field(at).name, pa.array(found, pa.list_(pa.string())))

    return rows.mapInArrow(run, T.StructType([T.StructField(tokens, T.ArrayType(T.StringType())) if f.name == tokens else f for f in rows.schema.fields]))
