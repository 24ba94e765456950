"""The subword engine: golden cases, SQL forms, and brute-force versions where SQL has none."""

import random
import re
import subprocess
import sys
from collections import Counter
from itertools import accumulate
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from piecework.functions import text as T
from piecework.functions.register import register_segmenters, register_texts
from piecework.operators import counts, evaluation, merging, segmentation, training
from piecework.plans import queries
from piecework.plans.queries import ORACLES, QUERIES
from piecework.sources import files, models
from piecework.streaming.counts import streaming_word_counts

SMALL = "/root/testdata/sf0.001"


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(same, name):
    same(QUERIES[name], ORACLES[name])


def learned(spark, texts, merges, **more):
    found, state = training.learn_merges(counts.weighted_segments(frame(spark, texts)), merges, **more)
    tokens = sorted(" ".join(r[0]) for r in state.select(training.tokens_of(F.col("state"), "#")).collect())
    return [(a + b, n) for a, b, n in found], tokens


def test_runs_merge_from_the_right(spark):
    assert learned(spark, ["aaa"], 10) == ([("aa", 2), ("aaa", 1)], ["aaa"])
    assert learned(spark, ["aaa"], 10, min_freq=1) == ([("aa", 2)], ["a aa"])


def test_initial_pairs_and_training(spark):
    segments = counts.weighted_segments(frame(spark, ["abab ab", "abc"]))
    assert {(r.a, r.b): r.freq for r in counts.pair_counts(segments).collect()} == {("a", "b"): 4, ("b", "a"): 1, ("b", "c"): 1}
    assert learned(spark, ["abab ab", "abc"], 10, min_freq=1)[0] == [("ab", 4)]
    assert learned(spark, [], 3) == ([], [])


def test_batched_merges_equal_single_ones(spark):
    segments = counts.weighted_segments(spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    many = training.learn_merges(segments, 25, batch=16)[0]
    assert many == training.learn_merges(segments, 25, batch=1)[0]


def test_words_merge_from_the_left(spark):
    words = spark.createDataFrame([("aaa", 1)], "seg string, w long")
    found, state = training.learn_merges(words, 10, policy=training.WORDS, ids=["<PAD>", "<UNK>", "a"])
    assert [(a, b) for a, b, _ in found] == [("a", "a"), ("aa", "a")]
    limited, _ = training.learn_merges(spark.createDataFrame([("abc", 1)], "seg string, w long"), 10, policy=training.WORDS, ids=["a", "b", "c"], longest=2)
    assert [(a, b) for a, b, _ in limited] == [("a", "b")]


def test_alphabet_order(spark):
    words = spark.createDataFrame([("ab", 2), ("b", 1)], "word string, freq long")
    ids = {r.c: r.id for r in counts.alphabet(words, ["z"], ["S"]).collect()}
    assert ids == {"<PAD>": 0, "<UNK>": 1, "S": 2, "z": 3, "b": 4, "a": 5}


def test_segments_and_unicode(spark):
    row = frame(spark, ["a,b\nc　d#e"]).select(T.segments(F.col("text"))).first()[0]
    assert row == ["a", "b", "c　d", "e"]
    assert frame(spark, ["a😀b"]).select(T.chars(F.col("text"))).first()[0] == ["a", "😀", "b"]
    assert frame(spark, ["é"]).select(T.chars(F.col("text"))).first()[0] == ["e", "́"]
    every = "x".join(["", *T.WORD_SPACE, ""])
    assert frame(spark, [every]).select(F.size(T.words(F.col("text")))).first()[0] == len(every.split())


def segmented(spark, text, vocab, method):
    words = spark.createDataFrame(list(vocab.items()), "token string, freq long")
    return segmentation.segment(frame(spark, [text]), words, method).first()["tokens"]


def test_longest_matches(spark):
    vocab = dict.fromkeys(["ab", "abc", "cd"], 1)
    assert segmented(spark, "abcd", vocab, "forward") == ["abc", "d"]
    assert segmented(spark, "abcd", vocab, "backward") == ["ab", "cd"]
    assert segmented(spark, "xabcd\nab", vocab, "bidirectional") == ["x", "ab", "cd", "\n", "ab"]
    assert segmented(spark, "", vocab, "bidirectional") == []
    assert segmented(spark, None, vocab, "merges") == []
    assert segmented(spark, "aaab", {"ab": 10, "aa": 5}, "merges") == ["aa", "ab"]


def test_joined_vocabulary_cuts_as_the_broadcast_one(spark):
    """Both paths and the plain version on random texts; a very long run, empty and null texts, clashing columns, no long tokens."""
    rng = random.Random(11)
    parts = lambda alphabet, n, most: ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, most))) for _ in range(n)]
    vocab = {t: rng.randint(1, 9) for t in {*parts("abc", 60, 5), *parts("ab \n", 20, 4), "[-^", "ä😀"}}
    texts = [*parts("abcd \n", 60, 40), "ab" * 2_000 + "c", "x[-^-ä😀]" * 3, "", None, "dd", "abc", "abc"]
    rows = spark.createDataFrame([(i % 5, t, f"r{i}", i) for i, t in enumerate(texts)], "at long, text string, row string, part int").repartition(4)
    words = spark.createDataFrame(list(vocab.items()), "token string, freq long")
    for method in segmentation.METHODS:
        found = {m: {r.row: r for r in segmentation.segment(rows, words, method, most=m).collect()} for m in (0, 1_000)}
        assert found[0] == found[1_000] and len(found[0]) == len(texts)
        assert all(found[0][f"r{i}"].tokens == plain_cut(t or "", vocab, method) for i, t in enumerate(texts) if len(t or "") < 100)
    joined, sent = ({r.row: r for r in segmentation.segment_all(rows, words, ["row"], most=m).collect()} for m in (0, 1_000))
    assert joined == sent and len(sent) == len(texts)
    single = words.where("length(token) = 1")
    assert all(r.tokens == list(r.text or "") for r in segmentation.segment(rows, single, "forward", most=0).collect())
    assert segmentation.segment(rows.where("at > 9"), words, "forward", most=0).count() == 0


def test_bidirectional_query_takes_one_of_both_ways(spark):
    found = {}
    for way in ("forward", "backward", "bidirectional"):
        rows = QUERIES[f"decode_{way}"](spark, SMALL).orderBy("item_id", "pos").collect()
        for r in rows:
            found.setdefault(r.item_id, {}).setdefault(way, []).append(r.token)
    singles = lambda x: (len(x), sum(len(t) == 1 for t in x))
    for ways in found.values():
        if "\n" not in "".join(ways["forward"]):
            one, two = ways["forward"], ways["backward"]
            assert ways["bidirectional"] == (one if singles(one) < singles(two) else two)


def test_merging_query_by_brute_force(spark):
    vocab = {r.token: r.freq for r in QUERIES["train_merges_v1"](spark, SMALL).collect()}
    for r in QUERIES["bpe_tokenize"](spark, SMALL).limit(300).collect():
        tokens = list(r.tokens.replace(" ", ""))
        while pairs := [(-vocab[a + b], a, b) for a, b in zip(tokens, tokens[1:], strict=False) if a + b in vocab]:
            _, a, b = min(pairs)
            i, out = len(tokens) - 1, []
            if a == b:
                while i >= 0:
                    hit = i > 0 and tokens[i] == b and tokens[i - 1] == a
                    out.insert(0, a + b if hit else tokens[i])
                    i -= 1 + hit
            else:
                k = 0
                while k < len(tokens):
                    hit = tokens[k : k + 2] == [a, b]
                    out.append(a + b if hit else tokens[k])
                    k += 1 + hit
            tokens = out
        assert r.tokens == " ".join(tokens)


# ---- learning and models, against plain versions ----


def brute_texts(segments, size, least):
    """One merge a round over all segments: the most frequent pair, then the least strings; equal ones from the right."""
    state, vocab = {s: list(s) for s in segments}, []
    while len(vocab) < size:
        counts = Counter()
        for s, tokens in state.items():
            for p in zip(tokens, tokens[1:]):
                counts[p] += segments[s]
        best = min(((-n, p) for p, n in counts.items()), default=(0, None))
        if -best[0] <= least:
            break
        a, b = best[1]
        vocab.append((a + b, -best[0]))
        for s, tokens in state.items():
            out, i = [], len(tokens) - 1
            while i >= 0:
                hit = i > 0 and (tokens[i - 1], tokens[i]) == (a, b)
                out.append(a + b if hit else tokens[i])
                i -= 1 + hit
            state[s] = out[::-1]
    return vocab


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with a few whole documents."""
    folder = tmp_path_factory.mktemp("few")
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 1500").orderBy("doc_id").limit(25)
    rows = rows.select("doc_id", "text").union(frame(spark, ["aaaa aaaaa aaa", "abababab abab", "", None]).withColumn("doc_id", F.col("doc_id") + 10**6))
    rows.coalesce(1).write.parquet(str(folder / "documents.parquet"))
    return str(folder), [r.text or "" for r in rows.collect()]


def test_vocabulary_of_500_by_brute_force(spark, small):
    folder, texts = small
    segments = Counter(x for t in texts for x in re.split("[" + re.escape(T.DELIMITERS + "#") + "]", t) if x)
    got = [(r.token, r.freq) for r in QUERIES["train_vocabulary"](spark, folder).orderBy("rank").collect()]
    assert got == brute_texts(segments, queries.VOCABULARY, queries.LEAST) and len(got) == 500


def test_single_characters_count_for_the_size(spark):
    vocab, _ = training.train_texts(frame(spark, ["abab ab", "abc"]), training.TextOptions(10, 1))
    assert [(r.token, r.freq) for r in vocab.orderBy("rank").collect()] == [("a", 4), ("b", 4), ("c", 1), ("ab", 4)]
    vocab, _ = training.train_texts(frame(spark, ["abab ab", "abc"]), training.TextOptions(3, 1))
    assert {r.token for r in vocab.collect()} == {"a", "b", "c"}
    assert training.train_texts(frame(spark, []), training.TextOptions(3))[0].count() == 0


def test_options_are_checked():
    for bad in ({"min_freq": -1}, {"vocab_size": -1}):
        with pytest.raises(ValueError):
            training.TextOptions(**{"vocab_size": 5} | bad)
    for bad in ({"max_piece_length": 1}, {"show_progress": False}):
        with pytest.raises(ValueError):
            training.WordOptions(**{"vocab_size": 5} | bad)
    options = training.WordOptions(5, min_frequency=-3, continuing_subword_prefix=None)
    assert (options.min_frequency, options.continuing_subword_prefix) == (1, "")


def brute_words(words, options):
    """Vocabulary, merges and the pieces of each word, one merge a round over tagged ids."""
    big = {"<PAD>": 2**60, "<UNK>": 2**59} | dict.fromkeys(options.initial_alphabet, 2**50) | dict.fromkeys(options.special_tokens, 2**51)
    for w, n in words.items():
        for c in w:
            big[c] = big.get(c, 0) + n
    strings = sorted(big, key=lambda c: (-big[c], c))
    strings = strings[: options.limit_alphabet + 2] if options.limit_alphabet else strings
    n_base, raw = len(strings), {c: i for i, c in enumerate(strings)}
    pre, suf = options.continuing_subword_prefix, options.end_of_word_suffix
    begin, end, mask = (1 << 31 if pre else 0), (1 << 30 if suf else 0), (1 << 30) - 1
    state = {w: [raw.get(c, 1) | (begin if i == 0 else 0) | (end if i == len(w) - 1 else 0) for i, c in enumerate(w)] for w in words}
    seen = {0, *(t for x in state.values() for t in x)} if pre or suf else set(range(n_base))
    base = [*range(2, n_base), *sorted(seen - set(range(n_base)))]
    length = lambda t: 1 if t & mask < n_base else len(strings[t & mask])
    show = lambda t: ("" if t & 1 << 31 else pre) + strings[t & mask] + (suf if t & 1 << 30 else "")
    ids, vocab, merges = {t: i for i, t in enumerate(base)}, [show(t) for t in base], []
    while len(seen) < options.vocab_size + 2:
        counts = Counter()
        for w, x in state.items():
            for a, b in zip(x, x[1:]):
                if a & mask >= 2 and b & mask >= 2 and length(a) + length(b) <= options.max_piece_length:
                    counts[a, b] += words[w]
        best = min(((-n, p) for p, n in counts.items()), default=(0, None))
        if best[1] is None or -best[0] < options.min_frequency:
            break
        a, b = best[1]
        string = strings[a & mask] + strings[b & mask]
        if string not in raw:
            raw[string] = len(strings)
            strings.append(string)
        new = raw[string] | (a & ~mask) | (b & ~mask)
        seen.add(new)
        merges.append((ids[a], ids[b], len(vocab), -best[0]))
        ids[new] = len(vocab)
        vocab.append(show(new))
        for w, x in state.items():
            out, i = [], 0
            while i < len(x):
                hit = x[i : i + 2] == [a, b]
                out.append(new if hit else x[i])
                i += 1 + hit
            state[w] = out
    return vocab, merges, {w: [ids.get(t, -1) for t in x] for w, x in state.items()}


def test_word_model_by_brute_force(spark, small):
    words = Counter(w for t in small[1] for w in t.split())
    table = spark.createDataFrame(list(words.items()), "word string, freq long")
    plain = training.WordOptions(90, 2, ["<S>"], 30, ["z"], "", "", max_piece_length=6)
    for options in (training.WordOptions(330, 2, ["<S>"], 0, ["z"], "##", "</w>", max_piece_length=12), plain):
        model = training.train_words(table, options)
        vocab, merges, pieces = brute_words(words, options)
        assert [r.token for r in model.vocab.orderBy("id").collect()] == vocab
        assert [tuple(r)[1:] for r in model.merges.orderBy("rank").collect()] == merges and len(merges) > 20
        found = segmentation.encode_ids(table, model)
        assert {r.word: r.ids for r in found.collect()} == pieces
        for r in segmentation.decode_ids(found, model).collect():
            assert r.text == r.word or -1 in r.ids
        lines = Counter(r.line for r in files.corpus_lines(model.corpus).collect())
        shown = Counter(" ".join(vocab[i] for i in x) for x in pieces.values() if -1 not in x)
        assert all(lines[k] >= 1 for k in shown)


def test_word_model_queries(spark, small):
    model = QUERIES["word_model"](spark, small[0]).collect()
    assert len(model) >= queries.VOCABULARY and sum(r.x is not None for r in model) > 100
    assert all(r.text == r.word for r in QUERIES["word_model_round_trip"](spark, small[0]).collect())


def test_golden_words(spark):
    words = spark.createDataFrame([("aaa", 1)], "word string, freq long")
    model = training.train_words(words, training.WordOptions(10, 1))
    assert [r.token for r in model.vocab.orderBy("id").collect()] == ["a", "aa", "aaa"]
    assert [(r.x, r.y, r.new) for r in model.merges.orderBy("rank").collect()] == [(0, 0, 1), (1, 0, 2)]


def plain_cut(text, vocab, method):
    if method == "bidirectional":
        out = []
        for i, line in enumerate(text.split("\n")):
            one, two = plain_cut(line, vocab, "forward"), plain_cut(line, vocab, "backward")
            cost = lambda x: (len(x), sum(len(t) == 1 for t in x))
            out += ["\n"] * (i > 0) + (one if cost(one) < cost(two) else two)
        return out
    if method == "merges":
        tokens = list(text)
        while pairs := [(-vocab[a + b], a, b) for a, b in zip(tokens, tokens[1:]) if a + b in vocab]:
            _, a, b = min(pairs)
            tokens, out = (tokens[::-1] if a == b else tokens), []
            while tokens:
                hit = tokens[:2] == [a, b]
                out.append(a + b if hit else tokens[0])
                tokens = tokens[1 + hit :]
            tokens = out[::-1] if a == b else out
        return tokens
    longest, out, back = max(map(len, vocab)), [], method == "backward"
    while text:
        size = next((k for k in range(min(longest, len(text)), 1, -1) if (text[-k:] if back else text[:k]) in vocab), 1)
        out.append(text[-size:] if back else text[:size])
        text = text[:-size] if back else text[size:]
    return out[::-1] if back else out


def test_segment_methods_by_brute_force(spark, small):
    folder, texts = small
    vocab = {r.token: r.freq for r in QUERIES["train_vocabulary"](spark, folder).collect()}
    rows = {(r.doc_id, r.method): (r.n_tokens, r.n_single) for r in QUERIES["segment_methods"](spark, folder).collect()}
    docs = {r.doc_id: (r.text or "").replace(" ", "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == 4 * len(docs)
    for (d, method), got in rows.items():
        tokens = plain_cut(docs[d], vocab, method)
        assert "".join(tokens) == docs[d] and got == (len(tokens), sum(len(t) == 1 for t in tokens))
    f1 = {(r.pred, r.true): (r.n_common, r.f1) for r in QUERIES["f1_methods"](spark, folder).collect()}
    cuts = {m: {(d, *x) for d, t in docs.items() for x in brute_spans(plain_cut(t, vocab, m))} for m in segmentation.METHODS}
    assert len(f1) == 16
    for (a, b), (n, value) in f1.items():
        assert n == len(cuts[a] & cuts[b]) and value == pytest.approx(2 * n / (len(cuts[a]) + len(cuts[b])), abs=1e-9)


def brute_spans(tokens):
    ends = [sum(map(len, tokens[: i + 1])) for i in range(len(tokens))] if len(tokens) < 50 else list(accumulate(map(len, tokens)))
    return [(b - len(t), b) for b, t in zip(ends, tokens) if t]


def test_f1_from_boundaries(spark):
    rows = [(["ab", "c"], ["a", "b", "c"], None), ([], ["x"], ["x"]), (["a", "", "😀b"], ["a", "😀b"], ["a😀", "b"]), (["abc"], ["abc"], ["a", "bc"])]
    frame = spark.createDataFrame(rows, "p array<string>, t array<string>, u array<string>")
    got = {(r.pred, r.true): (r.n_common, r.f1) for r in evaluation.f1_of_cuttings(frame, ["p", "t", "u"]).collect()}
    spans = {m: {(i, *x) for i, r in enumerate(rows) for x in brute_spans(r[k] or [])} for k, m in enumerate("ptu")}
    for a, b in got:
        n = len(spans[a] & spans[b])
        assert got[a, b] == (n, pytest.approx(2 * n / (len(spans[a]) + len(spans[b]))))
    assert {r.f1 for r in evaluation.f1_of_cuttings(frame.where("size(u) = 99"), ["p", "t"]).collect()} <= {0.0}


def test_longest_matches_do_not_look_at_the_longest_token():
    trie = segmentation.Trie(["ab", "abcd", "x" * 100_000])
    assert trie.cut("abcabcdx" + "ab") == ["ab", "c", "abcd", "x", "ab"]
    found = segmentation.Trie(["a" * 50_000, "ab"]).cut("ab" * 100_000)
    assert found == ["ab"] * 100_000


def test_saved_models(spark, tmp_path):
    """A model that is loaded gives the ids of the one that was saved; versions stay; what breaks off is not seen."""
    words = spark.createDataFrame([("abab", 4), ("abc", 3), ("bca", 2)], "word string, freq long")
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, path)
    first = training.train_words(words, training.WordOptions(8, 1, ["<S>"], continuing_subword_prefix="##", end_of_word_suffix="</w>"))
    second = training.train_words(words, training.WordOptions(20, 1))
    assert models.save_model(first, path) == 1 and models.save_model(second, path) == 2
    (tmp_path / "model" / "version-3").mkdir()
    for version, model in ((1, first), (2, second), (None, second)):
        loaded = models.load_model(spark.newSession(), path, version)
        ids = lambda m: {r.word: r.ids for r in segmentation.encode_ids(words, m).collect()}
        assert ids(loaded) == ids(model) and loaded.options == model.options
        assert sorted(map(tuple, loaded.corpus.collect())) == sorted(map(tuple, model.corpus.collect()))
    assert models.save_model(first, path) == 4
    twice = training.WordModel(spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "id long, token string"), *[None] * 5)
    assert {r.token: r.id for r in models.string_ids(twice).collect()} == {"a": 2, "b": 1}


def test_known_characters_of_a_table(spark):
    rows = spark.createDataFrame([(["ab", "<UNK>", "c"], "abxc"), (None, "q"), (["<UNK>", "<UNK>"], "😀"), (["<UNK>"], None)], "tokens array<string>, text string")
    found = segmentation.with_known_characters(rows.withColumn("text_", F.lit(1)))
    assert [r.tokens for r in found.collect()] == [["ab", "x", "c"], None, ["😀", ""], [""]] and found.columns == ["tokens", "text", "text_"]


def test_a_rewritten_folder_is_read_anew(spark, tmp_path):
    for text, want in (("abab abab", {"ab", "abab"}), ("xyxy xyxy", {"xy", "xyxy"})):
        frame(spark, [text]).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        assert {r.token for r in QUERIES["train_vocabulary"](spark, str(tmp_path)).collect()} == want


def random_segments(seed):
    rng = random.Random(seed)
    out = Counter("".join(rng.choice("abcd" if seed % 2 else "ab") for _ in range(rng.randint(1, 12))) for _ in range(120))
    out["ab" * 40 + "c"] += 3
    return out


@pytest.mark.parametrize("seed", range(6))
def test_guessed_merges_equal_plain_ones(spark, seed, monkeypatch):
    """Whatever is guessed, few pairs held, with the index or without it: the merges are those of one a round."""
    segments = random_segments(seed)
    table = spark.createDataFrame(list(segments.items()), "seg string, w long")
    monkeypatch.setattr(training, "HELD", (5, 50_000)[seed % 2])
    monkeypatch.setattr(training, "INDEX_FROM", (1, 10**9)[seed // 2 % 2])
    monkeypatch.setattr(training, "BUCKET_ROWS", 64)
    found, state = training.learn_merges(table, 60, 1, batch=(40, 3, 1)[seed % 3])
    assert [(a + b, n) for a, b, n in found] == brute_texts(segments, 60, 1)
    tokens = sorted((tuple(r[0]), r[1]) for r in state.select(training.tokens_of(F.col("state"), "#"), "w").collect())
    assert sorted("".join(t) for t, _ in tokens) == sorted(segments)
    ranks = {(a, b): ((i,), a + b) for i, (a, b, _) in enumerate(found)}
    for t, w in tokens:
        plain = merging.merge_by_rank(list("".join(t)), lambda a, b: ranks[a, b][0] if (a, b) in ranks else None, str.__add__, True)
        assert list(t) == plain and segments["".join(t)] == w


def test_a_round_reads_what_its_merges_touch(spark):
    """The segments that a lookup brings are few where the string is rare, and none is missing."""
    rows = [(f"{a}{b}{c}", 1) for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"] + [("zzz" + "k" * 60 + "q", 1)]
    table = training.Segments(spark.createDataFrame(rows, "seg string, w long"), True)
    found, finds = table.touched(["aku", "kq"])
    assert {r.seg for r in found.collect() if any(s in r.seg for s, _ in finds)} == {r for r, _ in rows if "aku" in r or "kq" in r}
    assert found.count() < 30
    table.remove()


def test_long_runs_are_merged_fast():
    found = segmentation.by_merges("ab" * 100_000 + "a" * 50_001, {"ab": 9, "aa": 5, "abab": 3})
    assert found == ["abab"] * 50_000 + ["a"] + ["aa"] * 25_000


def test_vocabularies_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(segmentation, "MOST_TOKENS", 2)
    with pytest.raises(ValueError):
        segmented(spark, "abc", dict.fromkeys(["ab", "bc", "abc"], 1), "forward")


def test_other_tools_tokens():
    assert segmentation.known_characters(["ab", "<UNK>", "c"], "abxc") == ["ab", "x", "c"]


def test_token_files(spark, tmp_path):
    rows = frame(spark, ["ab"]).select(F.array(F.lit("a"), F.lit("b")).alias("tokens"))
    files.write_tokens(rows, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "a b"
    files.write_token_list(spark.createDataFrame([(1, "b"), (0, "ab")], "rank long, token string"), str(tmp_path / "v"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "v")).collect()] == ["ab", "b"]
    assert files.without_spaces(frame(spark, ["a b\nc "])).first()["text"] == "ab\nc"
    (tmp_path / "a.txt").write_text("abab ab\nabc")
    vocab, _ = training.train_texts(files.read_texts(spark, [str(tmp_path / "a.txt")]), training.TextOptions(10, 1))
    assert {r.token for r in vocab.collect()} == {"a", "b", "c", "ab"}


def test_spans_and_f1(spark):
    rows = spark.createDataFrame([(1, "p", ["ab", "c"]), (1, "t", ["a", "b", "c"])], "doc int, method string, tokens array<string>")
    spans = evaluation.spans(rows, ["doc", "method"])
    assert sorted((r.start, r.end) for r in spans.where("method = 'p'").collect()) == [(0, 2), (2, 3)]
    f1 = {(r.pred, r.true): r.f1 for r in evaluation.f1_matrix(spans).collect()}
    assert f1[("p", "t")] == 0.4 and f1[("p", "p")] == 1.0


def test_joined_pieces(spark):
    assert frame(spark, ["ab@@ c,d"]).select(T.joined_pieces(F.col("text"))).first()[0] == ["ab", "c", ",", "d"]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("x\r\ny".encode())
    assert files.read_texts(spark, str(tmp_path / "a.txt")).first()["text"] == "x\ny"
    vocab = spark.createDataFrame([("ab", 3, 0), ("é", 5, 1)], "token string, freq long, rank long")
    files.write_vocabulary(vocab, str(tmp_path / "v"))
    assert {(r.token, r.freq) for r in files.read_vocabulary(spark, str(tmp_path / "v")).collect()} == {("ab", 3), ("é", 5)}


def test_streaming_word_counts(spark, tmp_path):
    source = tmp_path / "in"
    frame(spark, ["a b a", "b c", None]).write.parquet(str(source))
    stream = streaming_word_counts(spark.readStream.schema("doc_id long, text string").parquet(str(source)))
    run = stream.writeStream.format("memory").queryName("words_seen").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.word: r.freq for r in spark.table("words_seen").collect()} == {"a": 2, "b": 2, "c": 1}


def test_entry_stands_without_the_optional_parts(tmp_path):
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    for f in (root / "piecework").rglob("*.py"):
        if "llm" not in f.parts:
            to = tmp_path / f.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    code = "import __spark_entry__ as e; assert 'top_pairs' in e.queries() and not any(k.startswith('op1') for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_functions_from_sql(spark):
    """The registered functions give what the column functions and `segment` give."""
    register_texts(spark)
    every = "x".join(["", *T.WORD_SPACE, ""])
    texts = ["a,b\nc　d#e “q” ~x", every, "a😀b é", "", None, "abcd abc\nab"]
    frame(spark, texts).createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT text_normalised(text), text_segments(text), text_words(text), text_characters(text) FROM some_texts ORDER BY doc_id").collect()
    text = F.col("text")
    want = spark.table("some_texts").orderBy("doc_id").select(T.normalised(text), T.segments(text), T.words(text), T.chars(text)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    vocab = spark.createDataFrame([("ab", 9), ("abc", 5), ("cd", 7)], "token string, freq long")
    register_segmenters(spark, vocab)
    for method in segmentation.METHODS:
        got = spark.sql(f"SELECT doc_id, segment_{method}(text) AS tokens FROM some_texts").collect()
        want = {r.doc_id: r.tokens for r in segmentation.segment(spark.table("some_texts"), vocab, method).collect()}
        assert {r.doc_id: r.tokens for r in got} == want
        rows = spark.sql(f"SELECT doc_id, c.* FROM some_texts, LATERAL cut_text(text, '{method}') c ORDER BY doc_id, pos").collect()
        cut = {}
        for r in rows:
            assert texts[r.doc_id][r.start : r.end] == r.token and r.pos == len(cut.setdefault(r.doc_id, []))
            cut[r.doc_id].append(r.token)
        assert cut == {d: t for d, t in want.items() if t}


@pytest.mark.parametrize("from_right", [True, False])
def test_merges_of_many_segments_at_once(from_right):
    """Merges on arrays, packed and unpacked between, give the tokens and pairs of merges segment by segment."""
    from piecework.operators import flat
    from piecework.operators.merging import merged_once

    rng = random.Random(7)
    rows = [("".join(rng.choices("ab😀", k=rng.randrange(9))), rng.randrange(1, 5)) for _ in range(300)]
    want = [list(s) for s, _ in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["seg", "w"])
    (found,) = flat.FlatSegments.read(iter([batch]), list, from_right)
    for k, (a, b) in enumerate([("a", "a"), ("a", "b"), ("aa", "aa"), ("b", "b"), ("ab", "a"), ("😀", "😀")]):
        before = Counter()
        for t, (_, w) in zip(want, rows):
            for p in zip(t, t[1:]):
                before[p] -= w
        want = [merged_once(t, a, b, a + b, from_right) for t in want]
        for t, (_, w) in zip(want, rows):
            for p in zip(t, t[1:]):
                before[p] += w
        sums = flat.Sums()
        for codes, n in found.merge((a, b), a + b, changes=True):
            sums.add(k, codes, n)
        got = {(r["a"], r["b"]): r["n"] for r in sums.batch(found.names).to_pylist()} if sums.parts else {}
        assert got == {p: n for p, n in before.items() if n}
        (found,) = flat.FlatSegments.read(iter([found.packed()]), list, from_right)
        assert found.lists(str).to_pylist() == want


def test_few_merges_write_no_index(spark, monkeypatch):
    """An index of grams costs more than all rounds of a few hundred merges; the segments are kept packed instead."""
    monkeypatch.setattr(training, "REPLAYED", 1)
    monkeypatch.setattr(training.Segments, "_build", lambda self: pytest.fail("an index was built"))
    vocab, _ = training.train_texts(frame(spark, ["abab abc abab", "abc bcd abcd"]), training.TextOptions(500, 1, single_char=False))
    assert [(r.token, r.freq) for r in vocab.orderBy("rank").collect()][:2] == [("ab", 7), ("abc", 3)]


def test_words_are_counted_before_they_leave_a_task(spark, monkeypatch):
    """Tasks pass on words with counts, in parts, not each word of each text; white space is that of WORD_SPACE."""
    assert {c for c in map(chr, range(0x110000)) if not c.split()} == set(T.WORD_SPACE)
    texts = frame(spark, ["a b a\u2003é😀", None, "", " \x1c ", "a\x00 b\x85b\ufeff \u200b", "b " * 50, *T.WORD_SPACE])
    want = {r.word: r.freq for r in texts.select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("freq")).collect()}
    for most in (1, 3, counts.DISTINCT):
        monkeypatch.setattr(counts, "DISTINCT", most)
        found = counts.weighted_words(texts)
        assert {r.word: r.freq for r in found.collect()} == want and found.count() == len(want)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_alphabet_counts_characters(spark):
    """Characters beyond 16 bits count once, with the weights of their words."""
    words = spark.createDataFrame([("a😀a", 3), ("", 9), ("é", 5), ("b", 6), (None, 7)], "word string, freq long")
    assert [r.c for r in counts.alphabet(words).orderBy("id").collect()] == ["<PAD>", "<UNK>", "a", "b", "é", "😀"]


def test_segments_are_packed_from_the_start(spark):
    """Rounds read arrays, not strings, before the first merge too; first tokens are told from what the arrays name."""
    words = spark.createDataFrame([("ab", 2), ("b", 1), ("", 1), ("abc", 4)], "seg string, w long")
    start = training.TaggedCharacters({"a": 2, "b": 3}, True, True)
    segments, (begin, end) = training.Segments(words, False), (T.BEGIN, T.END)
    assert segments.first_tokens(start) == {f"{i}/1" for i in (2 | begin, 3 | end, 3 | begin | end, 3, 1 | end)}
    merges = training.Merges(start, False)
    assert segments.kept(merges).columns == ["tokens", "weights", "names"]
    pairs = {(r.a, r.b): r.freq for r in segments.pair_counts(merges).collect()}
    assert pairs == {(f"{2 | begin}/1", f"{3 | end}/1"): 2, (f"{2 | begin}/1", "3/1"): 4, ("3/1", f"{1 | end}/1"): 4}


def test_tallies_are_those_of_the_cuttings(spark):
    """Counts from bitmaps equal those of the tokens, for ties in frequency, equal neighbours, lines and empty texts."""
    rng = random.Random(5)
    vocab = {"".join(rng.choices("abc", k=rng.randrange(1, 6))): rng.randrange(1, 6) for _ in range(40)} | {"aa": 3, "é😀": 2}
    texts = ["", None, "\n", "\n\na", *("".join(rng.choices("abcé😀x\n", [6, 6, 6, 1, 1, 1, 1], k=rng.randrange(60))) for _ in range(300))]
    model = spark.createDataFrame(list(vocab.items()), "token string, freq long")
    found = segmentation.tally_all(frame(spark, texts), model, ["doc_id"]).orderBy("doc_id").collect()
    want = spark.createDataFrame([(i, *(plain_cut(t or "", vocab, m) for m in segmentation.METHODS)) for i, t in enumerate(texts)], "i long, " + ", ".join(f"{m} array<string>" for m in segmentation.METHODS))
    assert [r.sizes for r in found] == [[x for m in segmentation.METHODS for x in (len(r[m]), sum(len(t) == 1 for t in r[m]))] for r in want.orderBy("i").collect()]
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = evaluation.f1_of_tallies(segmentation.tally_all(frame(spark, texts), model, []), segmentation.METHODS)
    assert rows(got) == rows(evaluation.f1_of_cuttings(want, segmentation.METHODS))
    assert evaluation.f1_of_tallies(segmentation.tally_all(frame(spark, []), model, []), segmentation.METHODS).count() == 0
    assert segmentation.tally_all(frame(spark, texts), model, [], most=3) is None


def test_f1_takes_lengths_of_tokens(spark):
    """Lengths stand for tokens, and rows of a block do not run into each other."""
    rows = [(["ab", "c"], ["a", "b", "c"]), ([], ["x"]), (None, []), (["a"], ["a"])]
    cut = spark.createDataFrame(rows, "p array<string>, t array<string>")
    sizes = cut.select(*(F.transform(c, F.char_length).alias(c) for c in "pt"))
    want = {(r.pred, r.true): r.n_common for r in evaluation.f1_of_cuttings(cut, ["p", "t"]).collect()}
    assert want == {(r.pred, r.true): r.n_common for r in evaluation.f1_of_cuttings(sizes, ["p", "t"]).collect()}
    assert want == {("p", "p"): 3, ("t", "t"): 5, ("p", "t"): 2, ("t", "p"): 2}
