"""Token counts under a unigram vocabulary: Viterbi that keeps a score and a piece count for each position.

Tie rules are those of the public unigram tokenizers: of equally good ways to reach a position, the one whose
last piece starts first stays; a character that no single-character piece covers may also be read as unknown,
at the least score of the vocabulary less 10; unknown characters then fall back to one piece for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Parts whose counts a worker remembers, and characters of texts that it takes at once. Both change no result.
MEMO, BLOCK = 300_000, 1 << 20
#: Parts of fewer characters are counted many at once and remembered.
SHORT = 100
COUNTS = "doc_id long, n_tokens long, n_unknown long, score double"


class Vocabulary:
    """Pieces and scores, with an automaton that finds all pieces ending at each position.

    No best path crosses a place between two characters that stand side by side in no piece: texts are cut there
    into parts, and each distinct part is counted once.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = {p: float(s) for p, s in scores.items() if p}
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        import ahocorasick  # here, so that the other operators do not need it

        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if self.scores:
            self.automaton.make_automaton()
        known = {c for p in self.scores for c in p}
        beside = {ab for p in self.scores for ab in pairwise(p)}
        #: Numbers of the characters of pieces that have others beside them, 0 for all others; and which may stand side by side.
        self.joined = np.zeros(0x110000, np.int32)
        joined = sorted({c for ab in beside for c in ab})
        self.joined[[ord(c) for c in joined]] = np.arange(1, len(joined) + 1)
        self.beside = np.zeros((len(joined) + 1, len(joined) + 1), bool)
        for x, y in beside:
            self.beside[self.joined[ord(x)], self.joined[ord(y)]] = True
        #: Scores of characters as pieces, of no number where there is none.
        self.single = np.full(0x110000, np.nan)
        for c in known:
            self.single[ord(c)] = self.scores.get(c, np.nan)
        # Longer pieces by number, and a character that none of them has.
        longer = [p for p in self.scores if len(p) > 1]
        self.sizes, self.values = np.array([*map(len, longer)], np.int64), np.array([self.scores[p] for p in longer])
        self.numbers = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, piece in enumerate(longer):
            self.numbers.add_word(piece, i)
        if longer:
            self.numbers.make_automaton()
        self.other = next(c for c in map(chr, range(0x110000)) if c not in known)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        """The normal pieces of a sentencepiece model, with their scores."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = lambda i: m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
        return cls({m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not odd(i)})

    def count(self, text: str) -> tuple[int, int, float]:
        """(pieces, unknown characters, score) of the best path over a text with space marks."""
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count, unknown = [0] * (n + 1), [0] * (n + 1)
        single = bytearray(n)
        done = 0

        def fall_back(upto: int) -> None:
            # Positions are final once all pieces ending there were seen; only then may unknown characters extend them.
            nonlocal done
            while done < upto:
                if not single[done]:
                    way = best[done] + self.unknown
                    if best[done + 1] is None or way > best[done + 1]:
                        best[done + 1] = way
                        count[done + 1] = count[done] + len(text[done].encode("utf-8", "surrogatepass"))
                        unknown[done + 1] = unknown[done] + 1
                done += 1

        ending: list[tuple[int, float]] = []
        at = -1

        def settle() -> None:
            fall_back(at)
            for size, score in sorted(ending, reverse=True):
                start = at + 1 - size
                way = best[start] + score
                if best[at + 1] is None or way > best[at + 1]:
                    best[at + 1], count[at + 1], unknown[at + 1] = way, count[start] + 1, unknown[start]
                if size == 1:
                    single[at] = 1

        if self.scores:
            for end, found in self.automaton.iter(text):
                if end != at:
                    if ending:
                        settle()
                    at, ending = end, []
                ending.append(found)
            if ending:
                settle()
        fall_back(n)
        return count[n], unknown[n], best[n]

    def count_short(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`count` of each of many parts of 1 to SHORT - 1 characters: a place of all of them at a time."""
        text = self.other.join(parts)
        codes = _codes(text)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        heads = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        best, count, unknown = np.zeros(len(codes) + 1), np.zeros(len(codes) + 1, np.int64), np.zeros(len(codes) + 1, np.int64)
        # Ways to the place after each character: the character alone, as a piece or unknown, ...
        inner = np.ones(len(codes), bool)
        inner[heads[1:] - 1] = False
        at = np.flatnonzero(inner)
        value = self.single[codes[at]]
        odd = np.isnan(value)
        value[odd] = self.unknown
        # (an unknown one falls back to its bytes)
        made = np.where(odd, 1 + (codes[at] > 0x7F) + (codes[at] > 0x7FF) + (codes[at] > 0xFFFF), 1)
        # ... and the longer pieces that end with it.
        hits = np.fromiter(chain.from_iterable(self.numbers.iter(text)), np.int64) if len(self.sizes) else np.zeros(0, np.int64)
        last, piece = hits[::2], hits[1::2]
        end = np.concatenate([at, last]) + 1
        size = np.concatenate([np.ones(len(at), np.int64), self.sizes[piece]])
        value, made = np.concatenate([value, self.values[piece]]), np.concatenate([made, np.ones(len(last), np.int64)])
        odd = np.concatenate([odd, np.zeros(len(last), bool)])
        # By the place in the part, the part, and the longest piece first.
        place = end - np.repeat(heads, [*(sizes[:-1] + 1), sizes[-1] + 1])[end - 1]
        order = np.argsort((place * (len(codes) + 1) + end) * SHORT + (SHORT - size))
        end, value, made, odd, place = end[order], value[order], made[order], odd[order], place[order]
        start = end - size[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
        for i, j in pairwise(first.tolist()):
            way = best[start[i:j]] + value[i:j]
            groups = np.flatnonzero(np.diff(end[i:j], prepend=-1))
            most = np.maximum.reduceat(way, groups)
            # Of equally good ways the first.
            equal = np.flatnonzero(way == np.repeat(most, np.diff([*groups, j - i])))
            won = equal[np.diff(end[i:j][equal], prepend=-1) != 0] + i
            to, of = end[won], start[won]
            best[to], count[to], unknown[to] = most, count[of] + made[won], unknown[of] + odd[won]
        ends = heads + sizes
        return count[ends], unknown[ends], best[ends]

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces, unknown characters, score) of raw texts: a space mark before each and for each space. Empty texts have no pieces."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        out = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        if not sizes.any():
            return out
        text = "".join(marked)
        kinds = self.joined[_codes(text)]
        cut = np.concatenate([[True], ~self.beside[kinds[:-1], kinds[1:]]])
        some = np.flatnonzero(sizes)
        begins = (np.cumsum(sizes) - sizes)[some]
        cut[begins] = True
        cuts = np.flatnonzero(cut)
        parts = [text[i:j] for i, j in pairwise([*cuts.tolist(), len(text)])]
        if len(self.found[0]) > MEMO:
            self._forget()
        memo = self.memo
        at = np.fromiter(map(memo.get, parts, repeat(-1)), np.int64, len(parts))
        new = list(dict.fromkeys(parts[i] for i in np.flatnonzero(at < 0).tolist()))
        short, long = [p for p in new if len(p) < SHORT], [p for p in new if len(p) >= SHORT]
        counted = [self.count_short(short)] if short else []
        counted += [tuple(np.array([x]) for x in self.count(p)) for p in long]
        memo.update(zip(chain(short, long), range(len(self.found[0]), len(self.found[0]) + len(new)), strict=True))
        self.found = tuple(np.concatenate(x) for x in zip(self.found, *counted, strict=True))
        if new:
            missing = np.flatnonzero(at < 0)
            at[missing] = [memo[parts[i]] for i in missing.tolist()]
        for part in long:
            del memo[part]
        firsts = np.searchsorted(cuts, begins)
        for x, found in zip(out, self.found, strict=True):
            x[some] = np.add.reduceat(found[at], firsts)
        return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _blocks(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column, about BLOCK characters at a time."""
    block, size = [], 0
    for x in column:
        block.append(x.as_py() or "")
        size += len(block[-1])
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


_WORKER: dict[str, Vocabulary] = {}


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_unknown (characters), score: one row for each row of `docs`.

    `model` is the path of a sentencepiece file whose pieces and scores are read as a unigram vocabulary. Null
    and empty texts have 0 pieces and score 0; repeated rows are counted alike; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _WORKER.get(model) or _WORKER.setdefault(model, Vocabulary.from_sentencepiece(model))
        for batch in batches:
            found = [vocabulary.totals(block) for block in _blocks(batch["text"])]
            if found:
                columns = [batch["doc_id"], *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_unknown", "score"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, COUNTS)
