"""Learning byte-pair style merges: rounds over the segments that a few merges touch.

Merges are global, so a segment's tokens follow from its text and the merges so far: no state of segments is kept, only
the distinct segments themselves and, for many merges, an index of their grams, both written once. A round

1. guesses the merges to come from the best pairs, which the driver holds (`pairs.BestPairs`);
2. looks up the segments that contain a merged string, brings them up to date and plays the guessed merges
   through on them, in order; what each merge adds to and takes from the counts of pairs is summed in the cluster;
3. follows the guess as long as the exact counts agree with it. The rest of the guess is dropped.

So every merge is the best pair by exact counts, as if one merge were made a round. All pairs are counted anew only when
no held pair is certain to be the best one.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from piecework.functions import text as T
from piecework.operators.counts import PAD, UNK, alphabet, char_counts, weighted_segments
from piecework.operators.flat import PACKED, FlatSegments, Sums
from piecework.operators.pairs import BestPairs, Pair
from piecework.operators.store import Written

#: Pairs that the driver holds; the fewer, the more often all pairs are counted anew.
HELD = 50_000
#: Segments of at most so many characters are found by the grams of these lengths, longer ones are always looked through.
SHORT, GRAMS = 48, (2, 3)
#: Rows of a bucket of the index, and the most buckets.
BUCKET_ROWS, BUCKETS = 1 << 16, 4_096
#: Learning fewer merges does without the index: playing through all segments costs less than writing their grams.
INDEX_FROM = 2_000
#: Without the index the segments are written as arrays, and anew, brought up to date, when so many merges were made since.
REPLAYED = 24
#: The most frequent grams, which are looked up only where a string has no rarer one.
COMMON_GRAMS = 10_000
#: Merges that a round guesses at least.
AHEAD = 32


@dataclass(frozen=True)
class Policy:
    """How ties, self pairs and the stop are handled. `characters`: segments of text, strings in order, self pairs
    merged from the right, more than `min_freq`. `words`: words, ids in order, from the left, at least `min_freq`."""

    mark: str
    from_right: bool
    strict: bool
    by_id: bool


CHARACTERS = Policy("#", True, True, False)
WORDS = Policy(" ", False, False, True)


def wrapped(tokens: Column, mark: str) -> Column:
    return F.concat(F.lit(mark), F.array_join(tokens, mark * 2), F.lit(mark))


def tokens_of(state: Column, mark: str) -> Column:
    return F.split(F.substring(state, F.lit(2), F.length(state) - 2), mark * 2)


@dataclass
class Merges:
    """What tasks need to bring a segment up to date: its first tokens, and the merges in order."""

    start: Callable[[str], list]
    from_right: bool
    ranks: dict[Pair, tuple[int, Hashable]] = field(default_factory=dict)
    #: The merges in order, each with its new token. A pair is merged twice if a later merge makes one of its tokens anew.
    steps: list[tuple[Pair, Hashable]] = field(default_factory=list)

    def flat(self, batches: Iterator[pa.RecordBatch], played: int = 0) -> Iterator[FlatSegments]:
        """The segments of `batches` (seg, w, or packed after the first `played` merges), brought up to date."""
        for found in FlatSegments.read(batches, self.start, self.from_right):
            for pair, new in self.steps[played:]:
                found.merge(pair, new)
            yield found


@dataclass
class Changes:
    """Of each merge of a guess, by its number: the changes of pairs; and which merges touch tokens that an earlier one made."""

    by_step: dict[int, dict[Pair, int]] = field(default_factory=lambda: defaultdict(dict))
    meet: set[tuple[int, int]] = field(default_factory=set)

    def commute(self, guess: list[tuple[Pair, Hashable]], i: int, j: int) -> bool:
        """Whether merge j, played after the earlier i, never stood beside i or shared a token with it."""
        return (i, j) not in self.meet and guess[j][0] not in self.by_step[i] and guess[i][0] not in self.by_step[j]


class Segments:
    """Distinct segments (seg, w), written, and an index of the grams of short ones."""

    def __init__(self, segments: DataFrame | Written, indexed: bool):
        self.parts = [segments if isinstance(segments, Written) else Written(segments.select("seg", "w"), "segments")]
        self.spark = self.parts[0].spark
        self.table, self.index, self.common = self.parts[0].table, None, {}
        self.state, self.played = None, 0
        if indexed:
            self._build()

    def _build(self) -> None:
        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(g, s, w) for s, w in zip(batch["seg"].to_pylist(), batch["w"].to_pylist(), strict=True) for g in {s[i : i + k] for k in GRAMS for i in range(len(s) - k + 1)}]
                columns = zip(*found, strict=True) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["gram", "seg", "w"])

        short = self.table.where(F.length("seg") <= SHORT)
        rows = short.mapInArrow(grams, "gram string, seg string, w long")
        # Each character begins at most as many grams as there are lengths of them.
        expected = short.agg(F.coalesce(F.sum(F.length("seg")), F.lit(0))).first()[0] * len(GRAMS)
        self.buckets = max(1, min(BUCKETS, expected // BUCKET_ROWS))
        # A gram may stand in most segments, so its bucket is spread over several files.
        spread = F.pmod(F.hash("seg"), F.lit(max(1, expected // (self.buckets * BUCKET_ROWS))))
        rows = rows.withColumn("bucket", F.crc32(F.col("gram").cast("binary")) % self.buckets).repartition("bucket", spread).sortWithinPartitions("bucket", "gram")
        self.parts.append(Written(rows, "segment-grams", by=["bucket"]))
        self.index = self.parts[-1].table
        counts = self.index.groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(COMMON_GRAMS)
        self.common = {r["gram"]: r["count"] for r in counts.collect()}

    def kept(self, merges: Merges) -> DataFrame:
        """The segments as they stand after `self.played` merges, packed unless there is an index."""
        now = self.table if self.state is None else self.state.table
        if self.index is not None or (self.state is not None and len(merges.steps) - self.played < REPLAYED):
            return now
        shared, played, old = self.spark.sparkContext.broadcast(merges), self.played, self.state

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from (found.packed() for found in shared.value.flat(batches, played))

        self.state, self.played = Written(now.mapInArrow(run, PACKED), "packed-segments"), len(merges.steps)
        if old is not None:
            old.remove()
        return self.state.table

    def touched(self, strings: list[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
        """Rows (gram, seg, w) among which is every segment that contains one of `strings`, and the gram to find each by."""
        every = self.table.select(F.lit(None).cast("string").alias("gram"), "seg", "w")
        scanned = every.where(reduce(Column.__or__, [F.contains(F.col("seg"), F.lit(s)) for s in strings]))
        found = []
        for s in strings:
            k = min(len(s), GRAMS[-1])
            found.append((s, min((s[i : i + k] for i in range(len(s) - k + 1)), key=lambda g: (self.common.get(g, 0), g))))
        grams = sorted({g for _, g in found})
        buckets = sorted({zlib.crc32(g.encode()) % self.buckets for g in grams})
        short = self.index.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams)).select("gram", "seg", "w")
        return short.unionByName(scanned.where(F.length("seg") > SHORT)), found

    def tokens(self, merges: Merges, show: Callable[[Hashable], str] = str) -> DataFrame:
        """tokens, w: each segment's tokens as they stand and are shown."""
        shared = self.spark.sparkContext.broadcast((merges, show))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            merges, show = shared.value
            for found in merges.flat(batches):
                yield pa.RecordBatch.from_arrays([found.lists(show), pa.array(found.weights)], ["tokens", "w"])

        return self.table.mapInArrow(run, "tokens array<string>, w long")

    def first_tokens(self, start: Callable[[str], list]) -> set:
        """The tokens that some segment begins with before any merge."""
        rows = self.kept(Merges(start, False))
        if self.index is None:
            return {r["t"] for r in rows.select(F.explode("names").alias("t")).where("t IS NOT NULL").distinct().collect()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for found in Merges(start, False).flat(batches):
                seen.update(found.present())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["t"])

        return {r["t"] for r in rows.mapInArrow(run, "t string").distinct().collect()}

    def pair_counts(self, merges: Merges) -> DataFrame:
        """a, b, freq of all pairs as they stand."""
        rows = self.kept(merges)
        shared, played = self.spark.sparkContext.broadcast(merges), self.played

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums()
            for found in shared.value.flat(batches, played):
                sums.add(0, *found.pairs())
                if sums.full():
                    yield sums.batch(found.names).select(["a", "b", "n"])
            if sums.parts:
                yield sums.batch(found.names).select(["a", "b", "n"])

        return rows.mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("freq"))

    def changes(self, merges: Merges, guess: list[tuple[Pair, Hashable]], strings: list[str], beside: set[Pair], least: float) -> Changes:
        """What each merge of the guess, played through in order, adds to the counts of pairs.

        Of pairs without a token that the guess makes those in `beside` are told, of others those that gain `least`.
        """
        rows, finds = (self.kept(merges), []) if self.index is None else self.touched(strings)
        shared, played = self.spark.sparkContext.broadcast((merges, finds, guess, beside)), self.played

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            merges, finds, guess, beside = shared.value
            fresh = {new: k for k, (_, new) in enumerate(guess)}
            sums, meet = Sums(), set()

            def led(batch: pa.RecordBatch) -> pa.RecordBatch:
                # Several strings may lead to a segment: it counts where the first of them does.
                if not finds:
                    return batch
                pairs = zip(batch["gram"].to_pylist(), batch["seg"].to_pylist(), strict=True)
                firsts = ((gram, next((g for x, g in finds if x in s), None)) for gram, s in pairs)
                return batch.filter(pa.array([g is not None and gram in (None, g) for gram, g in firsts], pa.bool_()))

            def told(names: list) -> pa.RecordBatch:
                known = {p for p in beside if p[0] in at and p[1] in at} if (at := {t: i for i, t in enumerate(names)}) else set()
                wanted = np.array(sorted(at[a] << 32 | at[b] for a, b in known), np.int64)
                made = np.array(sorted(at[t] for t in fresh if t in at), np.int64)
                return sums.batch(names, lambda a, b: np.isin(a, made) | np.isin(b, made) | np.isin(a << 32 | b, wanted))

            for found in merges.flat(map(led, batches), played):
                for k, (pair, new) in enumerate(guess):
                    for codes, n in found.merge(pair, new, changes=True):
                        pairs = sums.add(k, codes, n)
                        # Tokens of the guess that stood beside this merge.
                        if n[0] < 0:
                            met = np.zeros(len(found.names), bool)
                            met[pairs >> 32] = met[pairs & 0xFFFFFFFF] = True
                            meet.update((i, k) for t, i in fresh.items() if t in found.numbers.number and met[found.numbers.number[t]])
                if sums.full():
                    yield told(found.names)
            if sums.parts:
                yield told(found.names)
            a, b = zip(*meet, strict=True) if meet else ([], [])
            kinds = zip(([str(x) for x in a], [None] * len(a), b, [1] * len(a)), (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in kinds], ["a", "b", "step", "n"])

        found = rows.mapInArrow(run, "a string, b string, step int, n long").groupBy("a", "b", "step").agg(F.sum("n").alias("n"))
        found = found.groupBy("a", "b").agg(F.collect_list(F.struct("step", "n")).alias("x"))
        gains = F.aggregate("x", F.lit(0).cast("long"), lambda s, x: s + F.greatest(x["n"], F.lit(0)))
        # A pair of old tokens only loses; it is there because it is held. Rows without b tell which merges meet.
        out = Changes()
        for r in found.where(F.col("b").isNull() | (gains == 0) | (gains >= least)).collect():
            for x in r["x"]:
                if r["b"] is None:
                    out.meet.add((int(r["a"]), x["step"]))
                else:
                    out.by_step[x["step"]][r["a"], r["b"]] = x["n"]
        return out

    def remove(self) -> None:
        """Removes the index; the segments stay, as tables that were returned read them."""
        for part in [*self.parts[1:], *([self.state] if self.state else [])]:
            part.remove()
        self.state, self.played = None, 0


class Strings:
    """Tokens as strings: names of merged ones, order and text."""

    def name(self, pair: Pair) -> str:
        return pair[0] + pair[1]

    def order(self, pair: Pair) -> tuple:
        return pair

    def text(self, token: str) -> str:
        return token

    def size(self) -> int:
        return 0

    def forget(self, size: int) -> None:
        """Drops the names that were given after `size()` was this."""


def learn(
    segments: Segments, merges: int, min_freq: int, policy: Policy, batch: int, names: Strings, start: Callable[[str], list], allowed: Callable[[Pair], bool], rank: list[Column], only: Column
) -> tuple[list[tuple[str, str, int]], Merges]:
    """The merges (a, b, frequency) in order. `allowed` and `only` say which pairs may be merged, on the driver and in tables."""
    done, found = Merges(start, policy.from_right), []
    least = min_freq + 1 if policy.strict else max(1, min_freq)

    def counted() -> BestPairs:
        rows = segments.pair_counts(done).where((F.col("freq") >= least) & only).orderBy(F.desc("freq"), *rank).limit(HELD + 1).collect()
        held = BestPairs(names.order)
        for r in rows[:HELD]:
            held.add((r["a"], r["b"]), r["freq"])
        if len(rows) > HELD:
            held.bound = held.rank((rows[HELD]["a"], rows[HELD]["b"]), rows[HELD]["freq"])
        return held

    # What the merges of a guess that were not taken would have changed, tokens of other such merges as the pairs they join.
    hints: dict[Pair, list[tuple[tuple, int]]] = {}

    def hint(pair: Pair, made: dict[Pair, Hashable]) -> list[tuple[Pair, int]] | None:
        def token(t: Hashable) -> Hashable | None:
            return t if not isinstance(t, tuple) else made[t] if t in made else done.ranks[t][1] if t in done.ranks else None

        if pair not in hints:
            return None
        found = [((token(x), token(y)), n) for (x, y), n in hints[pair]]
        return [(p, n) for p, n in found if None not in p]

    held, ahead = counted(), min(batch, AHEAD)
    while len(found) < merges:
        best = held.best()
        if best is None or best[1] < least:
            if held.bound is None or (best is not None and best[1] < least):
                break
            held = counted()
            if held.best() is None:
                break
            continue
        size = names.size()
        guess = held.guess(min(ahead, merges - len(found)), least, names.name, allowed, hint)
        # A merge of a token that the guess makes touches only segments that the making of this token touches.
        made = {new for _, new in guess}
        strings = [names.text(a) + names.text(b) for (a, b), _ in guess if a not in made and b not in made]
        beside = set().union(*(held.beside(pair) for pair, _ in guess))
        floor = least if held.bound is None else max(least, -held.bound[0])
        changes = segments.changes(done, guess, strings, beside, floor)
        names.forget(size)
        # The names of merges in the guess, and those that they have in the order in which they are taken.
        named, rest = {}, list(range(len(guess)))

        def now_named(pair: Pair) -> Pair:
            return tuple(named.get(t) if t in made else t for t in pair)

        while len(found) < merges and (now := held.best()) is not None and now[1] >= least:
            j = next((k for k in rest if now_named(guess[k][0]) == now[0]), None)
            if j is None or not all(changes.commute(guess, i, j) for i in rest if i < j):
                break
            rest.remove(j)
            new = named[guess[j][1]] = names.name(now[0])
            done.ranks[now[0]] = len(found), new
            done.steps.append((now[0], new))
            found.append((*now[0], int(now[1])))
            for pair, n in changes.by_step[j].items():
                other = now_named(pair)
                if None not in other and (other in held.counts or (n >= least and allowed(other))):
                    held.add(other, n)
        left = {guess[k][1]: now_named(guess[k][0]) for k in rest}
        token = lambda t: left[t] if t in left else named.get(t, t)  # noqa: B023, E731
        for k in rest:
            pair = guess[k][0]
            if not any(t in left for t in pair):
                hints[now_named(pair)] = [((token(x), token(y)), n) for (x, y), n in changes.by_step[k].items()]
        ahead = min(batch, max(AHEAD, 3 * (len(guess) - len(rest))))
    return found, done


def learn_strings(segments: DataFrame, merges: int, min_freq: int, policy: Policy, batch: int, longest: int = 0) -> tuple[list[tuple[str, str, int]], DataFrame]:
    """The merges (a, b, frequency) over tokens as strings, and tokens, w."""
    table = Segments(segments, merges >= INDEX_FROM)
    allowed = lambda p: not longest or len(p[0]) + len(p[1]) <= longest
    only = F.length("a") + F.length("b") <= longest if longest else F.lit(True)
    found, done = learn(table, merges, min_freq, policy, batch, Strings(), list, allowed, [F.col("a"), F.col("b")], only)
    table.remove()
    return found, table.tokens(done)


def learn_merges(
    segments: DataFrame, merges: int, min_freq: int = 0, policy: Policy = CHARACTERS, batch: int = 256, ids: list[str] | None = None, longest: int = 0
) -> tuple[list[tuple[str, str, int]], DataFrame]:
    """The merges (a, b, frequency) in order and the final (state, w). `segments`: (seg, w).

    `ids` lists the tokens in order where the policy goes by ids; `longest` bounds a token's code points.
    """
    if policy.by_id:
        # Untagged words, in terms of strings.
        order = [PAD, UNK, *(x for x in ids or [] if x not in (PAD, UNK))]
        learner = WordLearner(segments, order, False, False, merges >= INDEX_FROM)
        found, done = learner.run(merges, min_freq, longest, batch)
        tokens = learner.segments.tokens(done, Shown(learner.strings, "", ""))
        found = [(learner.text(a), learner.text(b), n) for a, b, n in found]
    else:
        found, tokens = learn_strings(segments, merges, min_freq, policy, batch, longest)
    return found, tokens.select(wrapped(F.col("tokens"), policy.mark).alias("state"), "w")


def vocabulary(spark: SparkSession, merges: list[tuple[str, str, int]]) -> DataFrame:
    """rank, token, freq: the frequency at which a token was merged."""
    return spark.createDataFrame([(i, a + b, n) for i, (a, b, n) in enumerate(merges)], "rank long, token string, freq long")


def token_usage(state: DataFrame, policy: Policy = CHARACTERS) -> DataFrame:
    tokens = state.select(F.explode(tokens_of(F.col("state"), policy.mark)).alias("token"), "w")
    return tokens.groupBy("token").agg(F.sum("w").alias("n"))


# ---- segments of text to a vocabulary of strings ----


@dataclass(frozen=True)
class TextOptions:
    """Options of the trainer over segments. With `single_char` single characters are in the vocabulary and count for
    its size; a pair is merged if it is found more than `min_freq` times. `compress_threshold` changes no result."""

    vocab_size: int
    min_freq: int = 10
    compress_threshold: float = 0.0
    single_char: bool = True

    def __post_init__(self) -> None:
        if self.vocab_size < 0 or self.min_freq < 0:
            raise ValueError("vocab_size and min_freq must not be negative")


def train_texts(docs: DataFrame, options: TextOptions, text: str = "text", batch: int = 256) -> tuple[DataFrame, DataFrame]:
    """The vocabulary (rank, token, freq) of a table of texts, single characters first if asked for, and the final (state, w)."""
    segments = Written(weighted_segments(docs, text), "segments").table
    spark = docs.sparkSession
    chars = char_counts(segments).orderBy(F.desc("freq"), "c").collect() if options.single_char else []
    merges, state = learn_merges(segments, max(0, options.vocab_size - len(chars)), options.min_freq, batch=batch)
    # A character stays where a merge could not be: merged tokens are longer.
    rows = [(r["c"], r["freq"]) for r in chars] + [(a + b, n) for a, b, n in merges]
    return spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(rows)], "rank long, token string, freq long"), state


# ---- words to a model of ids ----


@dataclass(frozen=True)
class WordOptions:
    """Options of the trainer over words; `min_frequency` is 1 at least, an empty prefix or suffix sets no tag."""

    vocab_size: int
    min_frequency: int = 1
    special_tokens: list[str] = field(default_factory=list)
    limit_alphabet: int = 0
    initial_alphabet: list[str] = field(default_factory=list)
    continuing_subword_prefix: str | None = ""
    end_of_word_suffix: str | None = ""
    show_progress: bool = True
    max_piece_length: int = 1 << 30

    def __post_init__(self) -> None:
        if self.show_progress is not True:
            raise ValueError("show_progress must be True")
        if self.max_piece_length <= 1:
            raise ValueError("max_piece_length must be greater than 1")
        object.__setattr__(self, "min_frequency", max(1, self.min_frequency))
        for name in ("continuing_subword_prefix", "end_of_word_suffix"):
            object.__setattr__(self, name, getattr(self, name) or "")


RAW = T.END - 1


def number(token: str) -> int:
    return int(token.split("/")[0])


@dataclass(frozen=True)
class TaggedCharacters:
    """The first tokens of a word: `id/1` of its characters, with bits on the first and last if asked for."""

    ids: dict[str, int]
    begin: bool
    end: bool

    def __call__(self, word: str) -> list[str]:
        found = [self.ids.get(c, 1) for c in word]
        if self.begin and found:
            found[0] |= T.BEGIN
        if self.end and found:
            found[-1] |= T.END
        return [f"{i}/1" for i in found]


@dataclass(frozen=True)
class Shown:
    """A token as displayed; the strings are the model's, a bounded number."""

    strings: list[str]
    prefix: str
    suffix: str

    def __call__(self, token: str) -> str:
        tagged = number(token)
        return (PAD, UNK)[tagged] if tagged < 2 else shown(self.strings[tagged & RAW], tagged, self.prefix, self.suffix)


class WordLearner(Strings):
    """Merges over tagged ids. A token is `id/length`, so order and length need no lookup."""

    def __init__(self, words: DataFrame | Written, alphabet: list[str], begin: bool, end: bool, indexed: bool):
        self.strings = list(alphabet)
        self.raw = {s: i for i, s in enumerate(self.strings)}
        self.start = TaggedCharacters(dict(self.raw), begin, end)
        self.segments = Segments(words, indexed)

    def text(self, token: str) -> str:
        return self.strings[number(token) & RAW]

    def name(self, pair: Pair) -> str:
        """The merged token: the id of its string, a new one if it has none, with the tags of both parts."""
        (x, m), (y, n) = ((int(k) for k in t.split("/")) for t in pair)
        string = self.strings[x & RAW] + self.strings[y & RAW]
        if string not in self.raw:
            self.raw[string] = len(self.strings)
            self.strings.append(string)
        return f"{self.raw[string] | (x & ~RAW) | (y & ~RAW)}/{m + n}"

    def order(self, pair: Pair) -> tuple:
        return number(pair[0]), number(pair[1])

    def size(self) -> int:
        return len(self.strings)

    def forget(self, size: int) -> None:
        for string in self.strings[size:]:
            del self.raw[string]
        del self.strings[size:]

    def run(self, merges: int, min_freq: int, longest: int, batch: int = 256) -> tuple[list[tuple[str, str, int]], Merges]:
        at = lambda c: F.substring_index(c, "/", 1).cast("long")
        size = lambda c: F.substring_index(c, "/", -1).cast("long")
        only = (at("a").bitwiseAND(F.lit(RAW)) >= 2) & (at("b").bitwiseAND(F.lit(RAW)) >= 2)
        only &= size("a") + size("b") <= longest if longest else F.lit(True)

        def allowed(pair: Pair) -> bool:
            (x, m), (y, n) = ((int(k) for k in t.split("/")) for t in pair)
            return x & RAW >= 2 and y & RAW >= 2 and (not longest or m + n <= longest)

        out = learn(self.segments, merges, min_freq, WORDS, batch, self, self.start, allowed, [at("a"), at("b")], only)
        self.segments.remove()
        return out


@dataclass
class WordModel:
    """vocab (id, token), merges (rank, x, y, new, freq) with model ids, base (tagged, id: model ids of characters),
    alphabet (id, c), and the final corpus (tokens as displayed, w)."""

    vocab: DataFrame
    merges: DataFrame
    base: DataFrame
    alphabet: DataFrame
    corpus: DataFrame
    options: WordOptions


def train_words(words: DataFrame, options: WordOptions, batch: int = 256) -> WordModel:
    """A model from words (word, freq). Model ids: alphabet ids from 2 on, then tagged characters in order, then merges."""
    spark = words.sparkSession
    written = Written(words.toDF("seg", "w"), "words")
    letters = alphabet(written.table.toDF("word", "freq"), options.initial_alphabet, options.special_tokens, options.limit_alphabet)
    letters = spark.createDataFrame(letters.orderBy("id").collect(), "id long, c string")
    begin, end = options.continuing_subword_prefix != "", options.end_of_word_suffix != ""
    order = [r["c"] for r in letters.collect()]
    n = len(order)
    learner = WordLearner(written, order, begin, end, options.vocab_size - n >= INDEX_FROM)
    seen = {0, *map(number, learner.segments.first_tokens(learner.start))} if begin or end else set(range(n))
    base = [*range(2, n), *sorted(seen - set(range(n)))]
    found, done = learner.run(max(0, options.vocab_size + 2 - len(seen)), options.min_frequency, options.max_piece_length, batch)
    to_model = {t: i for i, t in enumerate(base)}
    show = lambda t: shown(learner.strings[t & RAW], t, options.continuing_subword_prefix, options.end_of_word_suffix)
    tokens, merges = [show(t) for t in base], []
    for k, (a, b, freq) in enumerate(found):
        x, y, new = map(number, (a, b, learner.name((a, b))))
        merges.append((k, to_model[x], to_model[y], len(tokens), freq))
        to_model[new] = len(tokens)
        tokens.append(show(new))
    return WordModel(
        spark.createDataFrame(list(enumerate(tokens)), "id long, token string"),
        spark.createDataFrame(merges, "rank long, x long, y long, new long, freq long"),
        spark.createDataFrame([(t, i) for i, t in enumerate(base)], "tagged long, id long"),
        letters,
        learner.segments.tokens(done, Shown(learner.strings, options.continuing_subword_prefix, options.end_of_word_suffix)),
        options,
    )


def shown(string: str, tagged: int, prefix: str, suffix: str) -> str:
    """What `display` shows of a tagged token."""
    return ("" if tagged & T.BEGIN else prefix) + string + (suffix if tagged & T.END else "")
