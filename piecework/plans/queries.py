"""The registered queries of the subword engine and their DuckDB forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piecework.functions import text as T
from piecework.operators import counts, evaluation, segmentation, store, training
from piecework.sources import files, models

MERGES = 6
SPECIAL, INITIAL, LIMIT = ["<S>"], ["z"], 40
FREQUENT = 20_000


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.weighted_segments(_docs(spark, sf_dir))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.weighted_words(_docs(spark, sf_dir))


def _word_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of two characters or more that are a FREQUENTth of all words or more: never over FREQUENT, whatever the size."""
    words = _words(spark, sf_dir)
    total = words.agg(F.sum("freq").alias("total"))
    # One row of a global aggregate.
    frequent = words.where(F.length("word") >= 2).crossJoin(F.broadcast(total)).where(F.col("freq") * FREQUENT >= F.col("total"))
    return frequent.select(F.col("word").alias("token"), "freq")


def normalize_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


def line_dup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.line_duplicates(_docs(spark, sf_dir))


def char_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.char_counts(_segments(spark, sf_dir))


def pair_freq_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.pair_counts(_segments(spark, sf_dir))


def pair_freq_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.pair_counts(_segments(spark, sf_dir), least=100)


def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_freq_init(spark, sf_dir).orderBy(F.desc("freq"), "a", "b").limit(20)


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir)


def alphabet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.alphabet(_words(spark, sf_dir), INITIAL, SPECIAL)


def alphabet_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.alphabet(_words(spark, sf_dir), INITIAL, SPECIAL, LIMIT)


def encode_words_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    found = counts.tagged_ids(words, counts.alphabet(words, limit=LIMIT), begin=True, end=True)
    return found.select("word", "freq", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def weighted_pairs_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of character ids in words, unknown ones left out."""
    words = _words(spark, sf_dir)
    found = counts.tagged_ids(words, counts.alphabet(words, limit=LIMIT))
    pairs = counts.pair_counts(found.withColumnRenamed("freq", "w"), tokens=F.transform("ids", lambda x: x.cast("string")))
    pairs = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "freq")
    return pairs.where("a >= 2 AND b >= 2")


def train_merges_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.vocabulary(spark, training.learn_merges(_segments(spark, sf_dir), MERGES)[0])


def _learn_v2(words: DataFrame) -> tuple[list, DataFrame]:
    ids = [r["c"] for r in counts.alphabet(words).orderBy("id").collect()]
    return training.learn_merges(words.toDF("seg", "w"), MERGES, policy=training.WORDS, ids=ids)


def train_merges_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written, so that the texts are cut into words once.
    return training.vocabulary(spark, _learn_v2(store.Written(_words(spark, sf_dir), "words").table)[0])


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.token_usage(training.learn_merges(_segments(spark, sf_dir), MERGES)[1])


def vocab_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trained vocabulary by frequency, ties in the order of training."""
    return train_merges_v1(spark, sf_dir).orderBy(F.desc("freq"), "rank")


def encode_words_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = store.Written(_words(spark, sf_dir), "words").table
    merges, _ = _learn_v2(words)
    found = segmentation.encode_words(words, merges)
    return found.select("word", F.array_join("tokens", " ").alias("tokens"))


def display_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = alphabet_limited(spark, sf_dir)
    tags = F.explode(F.array(*(F.lit(x).cast("long") for x in (0, T.BEGIN, T.END, T.BEGIN | T.END))))
    rows = ids.select("id", "c", tags.alias("tag")).where("id >= 2 OR tag = 0")
    tagged = F.col("id").bitwiseOR(F.col("tag"))
    return rows.select(tagged.alias("tagged"), T.display(F.col("c"), tagged, "#", "@").alias("shown"))


def _segmented(method: str):  # noqa: ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = segmentation.segment(_benchmark(spark, sf_dir), _word_vocabulary(spark, sf_dir), method)
        return found.select("item_id", F.posexplode("tokens").alias("pos", "token"))

    query.__name__ = method
    return query


def bpe_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw merging by the vocabulary of learned tokens, over the benchmark's segments."""
    vocab = train_merges_v1(spark, sf_dir)
    segments = _benchmark(spark, sf_dir).select("item_id", F.posexplode(T.segments(F.col("text"))).alias("seg_no", "text"))
    found = segmentation.segment(segments, vocab, "merges")
    return found.select("item_id", "seg_no", F.array_join("tokens", " ").alias("tokens"))


#: Size of the vocabulary that is learned where no SQL form has to follow, and how often a pair must be found.
VOCABULARY, LEAST = 500, 1
#: Options of the model of words: tags as in word-end models, pieces of at most 12 characters.
MODEL = training.WordOptions(vocab_size=VOCABULARY, min_frequency=2, special_tokens=SPECIAL, continuing_subword_prefix="##", end_of_word_suffix="</w>", max_piece_length=12)


def _learned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = training.TextOptions(VOCABULARY, LEAST, single_char=False)
    return training.train_texts(_docs(spark, sf_dir), options)[0]


def _learned_words(words: DataFrame) -> training.WordModel:
    return training.train_words(words, MODEL)


def train_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rank, token, freq of a vocabulary of VOCABULARY tokens of two characters and more, from all documents."""
    return _learned_texts(spark, sf_dir)


def segment_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, method, n_tokens, n_single: all documents, without spaces, cut four ways by the learned vocabulary."""
    docs, vocab = files.without_spaces(_docs(spark, sf_dir)), train_vocabulary(spark, sf_dir)
    if (tallied := segmentation.tally_all(docs, vocab, ["doc_id"])) is not None:
        sizes = lambda k: F.get("sizes", F.lit(k)).cast("int")
        kinds = [F.struct(F.lit(m).alias("method"), sizes(2 * k).alias("n_tokens"), sizes(2 * k + 1).alias("n_single")) for k, m in enumerate(segmentation.METHODS)]
        return tallied.select("doc_id", F.explode(F.array(*kinds)).alias("x")).select("doc_id", "x.*")
    found = segmentation.segment_all(docs, vocab, ["doc_id"])
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.size(m).alias("n_tokens"), T.single_count(F.col(m)).alias("n_single")) for m in segmentation.METHODS)))
    return found.select("doc_id", each.alias("x")).select("doc_id", "x.*")


def f1_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of the four ways against each other over all documents."""
    docs, vocab = files.without_spaces(_docs(spark, sf_dir)), train_vocabulary(spark, sf_dir)
    if (tallied := segmentation.tally_all(docs, vocab, [])) is not None:
        return evaluation.f1_of_tallies(tallied, segmentation.METHODS)
    found = segmentation.segment_all(docs, vocab, ["doc_id"])
    return evaluation.f1_of_cuttings(found, segmentation.METHODS)


def word_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of words as one table: id, token, and x, y, freq where a merge gave the token."""
    model = _learned_words(_words(spark, sf_dir))
    return model.vocab.join(model.merges.select(F.col("new").alias("id"), "x", "y", "freq"), "id", "left")


def word_model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, n_ids, ids, text: every distinct word as ids of the model, saved and loaded again, and back."""
    path = f"{store.shared_folder(spark)}/word-model-{uuid.uuid4().hex}"
    # Written, so that the texts are cut into words once.
    words = store.Written(_words(spark, sf_dir), "words").table
    models.save_model(_learned_words(words), path)
    model = models.load_model(spark, path)
    found = segmentation.decode_ids(segmentation.encode_ids(words, model), model)
    return found.select("word", F.size("ids").alias("n_ids"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), "text")


def known_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens: pieces of all documents as a tool gives them that knows no delimiter, the unknown ones put back."""
    pieces = F.transform(T.with_delimiters(F.col("text")), lambda t: F.when(F.instr(F.lit(T.DELIMITERS), t) > 0, "<UNK>").otherwise(t))
    found = segmentation.with_known_characters(_docs(spark, sf_dir).withColumn("tokens", pieces))
    return found.select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", "|").cast("binary")).alias("digest"))


def f1_cuttings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of three ways to cut all documents against each other, from boundaries in the row."""
    text = F.col("text")
    ways = {"chars": T.chars(text), "puncs": T.with_delimiters(text), "joined": T.joined_pieces(F.replace(text, F.lit("th"), F.lit("t@@ h")))}
    lengths = {k: F.transform(x, F.char_length) for k, x in ways.items()}
    # Characters have the length 1, so that they need not be made.
    lengths["chars"] = F.array_repeat(F.lit(1), F.char_length(text))
    return evaluation.f1_of_cuttings(_docs(spark, sf_dir).select(*(x.alias(k) for k, x in lengths.items())), list(ways))


def split_with_puncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark(spark, sf_dir).select("item_id", F.posexplode(T.with_delimiters(F.col("text"))).alias("pos", "token"))


def nmt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.replace(F.col("text"), F.lit("th"), F.lit("t@@ h"))
    return _benchmark(spark, sf_dir).select("item_id", F.posexplode(T.joined_pieces(marked)).alias("pos", "token"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _benchmark(spark, sf_dir)
    ways = {"chars": T.chars(F.col("text")), "puncs": T.with_delimiters(F.col("text")), "joined": T.joined_pieces(F.replace(F.col("text"), F.lit("th"), F.lit("t@@ h")))}
    rows = [texts.select(F.col("item_id").alias("doc"), F.lit(k).alias("method"), x.alias("tokens")) for k, x in ways.items()]
    return evaluation.spans(rows[0].union(rows[1]).union(rows[2]), ["doc", "method"])


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)


def f1_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.f1_matrix(_spans(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_segments, line_dup_ratio, char_freq, pair_freq_init, pair_freq_pruned, top_pairs, word_counts, alphabet_ids, alphabet_limited,
        encode_words_ids, weighted_pairs_v2, train_merges_v1, train_merges_v2, token_usage, vocab_dump, encode_words_merges, display_tokens,
        bpe_tokenize, train_vocabulary, segment_methods, f1_methods, word_model, word_model_round_trip, known_characters, f1_cuttings, split_with_puncs, nmt_parse, spans, f1_matrix,
    )
} | {f"decode_{m}": _segmented(m) for m in ("forward", "backward", "bidirectional")}


# ---- DuckDB forms ----

def _chr(chars: str) -> str:
    return "||".join(f"chr({ord(c)})" for c in chars)


_SEG = f"""segs AS (SELECT seg, count(*) AS w FROM (
    SELECT unnest(string_split(translate(text, {_chr(T.DELIMITERS)}, '{"#" * len(T.DELIMITERS)}'), '#')) AS seg FROM documents) WHERE seg <> '' GROUP BY seg)"""
_WORD = f"""words AS (SELECT word, count(*) AS freq FROM (
    SELECT unnest(string_split_regex(text, '{T.char_class(T.WORD_SPACE)}+')) AS word FROM documents) WHERE word <> '' GROUP BY word)"""
_PAIRS = "pairs AS (SELECT seg[i] AS a, seg[i+1] AS b, sum(w)::BIGINT AS freq FROM (SELECT seg, w, unnest(range(1, length(seg))) AS i FROM segs) GROUP BY 1, 2)"


def _alphabet(initial: list[str], special: list[str], limit: int = 0) -> str:
    fixed = {counts.PAD: 1 << 60, counts.UNK: 1 << 59} | dict.fromkeys(initial, 1 << 50) | dict.fromkeys(special, 1 << 51)
    rows = ", ".join(f"('{k}', {v}::BIGINT)" for k, v in fixed.items())
    return f"""alphabet AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY sum(f) DESC, c) - 1 AS id, c FROM (
        SELECT * FROM (VALUES {rows}) v(c, f) UNION ALL
        SELECT word[i], freq FROM (SELECT word, freq, unnest(range(1, length(word) + 1)) AS i FROM words)) GROUP BY c) {f"WHERE id < {limit + 2}" if limit else ""})"""


def _merges(mark: str, source: str, right: bool) -> str:
    """Unrolled rounds over strings of marked tokens: count, take the best, rewrite."""
    parts = [f"s0 AS (SELECT '{mark}' || array_to_string(list_transform(range(1, length(seg) + 1), lambda i: seg[i]), '{mark * 2}') || '{mark}' AS s, w FROM {source})"]
    for k in range(MERGES):
        ids = "" if right else f" JOIN known{k} ka ON ka.t = a JOIN known{k} kb ON kb.t = b"
        order = "a, b" if right else "ka.i, kb.i"
        if not right:
            known = "SELECT c AS t, id AS i FROM alphabet" + "".join(f" UNION ALL SELECT a || b, 1000000 + {j} FROM best{j}" for j in range(k))
            parts.append(f"known{k} AS ({known})")
        parts.append(f"""best{k} AS MATERIALIZED (SELECT a, b, freq FROM (SELECT t[i] AS a, t[i+1] AS b, sum(w)::BIGINT AS freq FROM (
            SELECT t, w, unnest(range(1, len(t))) AS i FROM (SELECT string_split(s[2:length(s)-1], '{mark * 2}') AS t, w FROM s{k})) GROUP BY 1, 2){ids} ORDER BY freq DESC, {order} LIMIT 1)""")
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT replace(s, '{mark}' || a || '{mark * 2}' || b || '{mark}', '{mark}' || a || b || '{mark}') AS s, w FROM s{k}, best{k})")
    return ", ".join(parts)


_LEARNED = " UNION ALL ".join(f"SELECT {k}::BIGINT AS rank, a || b AS token, freq FROM best{k}" for k in range(MERGES))
_V2 = f"{_WORD}, {_alphabet([], [])}, wsegs AS (SELECT word AS seg, freq AS w FROM words)"
def _tokens(column: str = "text") -> str:
    return f"regexp_extract_all({column}, '{T.char_class(T.DELIMITERS, True)}+|{T.char_class(T.DELIMITERS)}')"


_JOINED = f"flatten(list_transform(string_split(replace(text, 'th', 't@@ h'), '@@ '), lambda x: {_tokens('x')}))"


def _exploded(tokens: str) -> str:
    return f"SELECT item_id, unnest(range(0, len(t)))::INTEGER AS pos, unnest(t) AS token FROM (SELECT item_id, {tokens} AS t FROM benchmark)"


_SPANS = f"""toks AS (
    SELECT item_id AS doc, 'chars' AS method, list_transform(range(1, length(text) + 1), lambda i: text[i]) AS t FROM benchmark
    UNION ALL SELECT item_id, 'puncs', {_tokens()} FROM benchmark UNION ALL SELECT item_id, 'joined', {_JOINED} FROM benchmark),
  each_ AS (SELECT doc, method, unnest(range(0, len(t))) AS pos, unnest(t) AS token FROM toks),
  spans AS (SELECT doc, method, ("end" - n)::BIGINT AS start, "end" FROM (
    SELECT doc, method, length(token) AS n, sum(length(token)) OVER (PARTITION BY doc, method ORDER BY pos)::BIGINT AS "end" FROM each_))"""
_VOCAB = f"{_WORD}, vocab AS (SELECT word FROM words WHERE length(word) >= 2 AND freq * {FREQUENT} >= (SELECT sum(freq) FROM words))"
_PLACES = """places AS (SELECT item_id, s, l FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS s FROM benchmark),
    (SELECT DISTINCT length(word) AS l FROM vocab) WHERE s + l - 1 <= length(text) AND substring(text, s, l) IN (SELECT word FROM vocab))"""

ORACLES = {
    "normalize_segments": f"WITH {_SEG} SELECT seg, w FROM segs",
    "line_dup_ratio": "SELECT count(*) AS n_lines, count(DISTINCT line) AS n_unique FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)",
    "char_freq": f"WITH {_SEG} SELECT seg[i] AS c, sum(w)::BIGINT AS freq FROM (SELECT seg, w, unnest(range(1, length(seg) + 1)) AS i FROM segs) GROUP BY 1",
    "pair_freq_init": f"WITH {_SEG}, {_PAIRS} SELECT * FROM pairs",
    "pair_freq_pruned": f"WITH {_SEG}, {_PAIRS} SELECT * FROM pairs WHERE freq >= 100",
    "top_pairs": f"WITH {_SEG}, {_PAIRS} SELECT * FROM pairs ORDER BY freq DESC, a, b LIMIT 20",
    "word_counts": f"WITH {_WORD} SELECT * FROM words",
    "alphabet_ids": f"WITH {_WORD}, {_alphabet(INITIAL, SPECIAL)} SELECT * FROM alphabet",
    "alphabet_limited": f"WITH {_WORD}, {_alphabet(INITIAL, SPECIAL, LIMIT)} SELECT * FROM alphabet",
    "encode_words_ids": f"""WITH {_WORD}, {_alphabet([], [], LIMIT)} SELECT word, any_value(freq) AS freq, string_agg(
        ((coalesce(id, 1)) | (CASE WHEN i = 1 THEN {T.BEGIN} ELSE 0 END) | (CASE WHEN i = length(word) THEN {T.END} ELSE 0 END))::VARCHAR, ' ' ORDER BY i) AS ids
        FROM (SELECT word, freq, unnest(range(1, length(word) + 1)) AS i FROM words) LEFT JOIN alphabet ON c = word[i] GROUP BY word""",
    "weighted_pairs_v2": f"""WITH {_WORD}, {_alphabet([], [], LIMIT)} SELECT x.id AS a, y.id AS b, sum(freq)::BIGINT AS freq
        FROM (SELECT word, freq, unnest(range(1, length(word))) AS i FROM words) JOIN alphabet x ON x.c = word[i] JOIN alphabet y ON y.c = word[i+1]
        WHERE x.id >= 2 AND y.id >= 2 GROUP BY 1, 2""",
    "train_merges_v1": f"WITH {_SEG}, {_merges('#', 'segs', True)} {_LEARNED}",
    "train_merges_v2": f"WITH {_V2}, {_merges(' ', 'wsegs', False)} {_LEARNED}",
    "vocab_dump": f"WITH {_SEG}, {_merges('#', 'segs', True)} {_LEARNED}",
    "token_usage": f"""WITH {_SEG}, {_merges('#', 'segs', True)} SELECT token, sum(w)::BIGINT AS n FROM (
        SELECT unnest(string_split(s[2:length(s)-1], '##')) AS token, w FROM s{MERGES}) GROUP BY 1""",
    "encode_words_merges": f"""WITH {_V2}, {_merges(' ', 'wsegs', False)} SELECT replace(s, ' ', '') AS word, replace(s[2:length(s)-1], '  ', ' ') AS tokens FROM s{MERGES}""",
    "display_tokens": f"""WITH {_WORD}, {_alphabet(INITIAL, SPECIAL, LIMIT)} SELECT id | tag AS tagged,
        CASE WHEN id | tag = 0 THEN '<PAD>' WHEN id | tag = 1 THEN '<UNK>' ELSE (CASE WHEN tag & {T.BEGIN} <> 0 THEN '' ELSE '#' END) || c || (CASE WHEN tag & {T.END} <> 0 THEN '@' ELSE '' END) END AS shown
        FROM alphabet, (VALUES (0::BIGINT), ({T.BEGIN}::BIGINT), ({T.END}::BIGINT), ({T.BEGIN | T.END}::BIGINT)) t(tag) WHERE id >= 2 OR tag = 0""",
    "known_characters": f"SELECT doc_id, len({_tokens()}) AS n_tokens, md5(array_to_string({_tokens()}, '|')) AS digest FROM documents",
    "f1_cuttings": f"""WITH {_SPANS.replace("item_id AS doc", "doc_id AS doc").replace("SELECT item_id", "SELECT doc_id").replace("benchmark", "documents")}, sizes AS (SELECT method, count(*) AS n FROM spans GROUP BY 1),
        common AS (SELECT x.method AS pred, y.method AS "true", count(*) AS n FROM spans x JOIN spans y USING (doc, start, "end") GROUP BY 1, 2)
        SELECT p.method AS pred, t.method AS "true", coalesce(c.n, 0) AS n_common, round(2 * coalesce(c.n, 0) / (p.n + t.n), 10) AS f1
        FROM sizes p CROSS JOIN sizes t LEFT JOIN common c ON c.pred = p.method AND c."true" = t.method""",
    "split_with_puncs": _exploded(_tokens()),
    "nmt_parse": _exploded(_JOINED),
    "spans": f"WITH {_SPANS} SELECT * FROM spans",
    "f1_matrix": f"""WITH {_SPANS}, sizes AS (SELECT method, count(*) AS n FROM spans GROUP BY 1),
        common AS (SELECT x.method AS pred, y.method AS "true", count(*) AS n FROM spans x JOIN spans y USING (doc, start, "end") GROUP BY 1, 2)
        SELECT p.method AS pred, t.method AS "true", coalesce(c.n, 0) AS n_common, round(2 * coalesce(c.n, 0) / (p.n + t.n), 10) AS f1
        FROM sizes p CROSS JOIN sizes t LEFT JOIN common c ON c.pred = p.method AND c."true" = t.method""",
    "decode_forward": f"""WITH RECURSIVE {_VOCAB}, {_PLACES}, best AS (SELECT item_id, s, max(l) AS l FROM places GROUP BY 1, 2),
        walk AS (SELECT item_id, text, 0 AS pos, 1::BIGINT AS s FROM benchmark WHERE text <> ''
            UNION ALL SELECT w.item_id, text, pos + 1, w.s + coalesce(b.l, 1) FROM walk w LEFT JOIN best b ON b.item_id = w.item_id AND b.s = w.s WHERE w.s + coalesce(b.l, 1) <= length(text))
        SELECT w.item_id, pos, substring(text, w.s, coalesce(b.l, 1)) AS token FROM walk w LEFT JOIN best b ON b.item_id = w.item_id AND b.s = w.s""",
    "decode_backward": f"""WITH RECURSIVE {_VOCAB}, {_PLACES}, best AS (SELECT item_id, s + l - 1 AS e, max(l) AS l FROM places GROUP BY 1, 2),
        walk AS (SELECT item_id, text, 0 AS back, length(text)::BIGINT AS e FROM benchmark WHERE text <> ''
            UNION ALL SELECT w.item_id, text, back + 1, w.e - coalesce(b.l, 1) FROM walk w LEFT JOIN best b ON b.item_id = w.item_id AND b.e = w.e WHERE w.e - coalesce(b.l, 1) >= 1)
        SELECT w.item_id, (max(back) OVER (PARTITION BY w.item_id) - back)::INTEGER AS pos, substring(text, w.e - coalesce(b.l, 1) + 1, coalesce(b.l, 1)) AS token
        FROM walk w LEFT JOIN best b ON b.item_id = w.item_id AND b.e = w.e""",
    "decode_bidirectional": f"""WITH RECURSIVE {_VOCAB},
        lines AS (SELECT item_id, unnest(range(0, len(x))) AS line, unnest(x) AS text FROM (SELECT item_id, string_split(text, chr(10)) AS x FROM benchmark)),
        places AS (SELECT item_id, line, s, l FROM (SELECT item_id, line, text, unnest(range(1, length(text) + 1)) AS s FROM lines),
            (SELECT DISTINCT length(word) AS l FROM vocab) WHERE s + l - 1 <= length(text) AND substring(text, s, l) IN (SELECT word FROM vocab)),
        fbest AS (SELECT item_id, line, s, max(l) AS l FROM places GROUP BY ALL), bbest AS (SELECT item_id, line, s + l - 1 AS e, max(l) AS l FROM places GROUP BY ALL),
        fwalk AS (SELECT item_id, line, text, 0 AS pos, 1::BIGINT AS s FROM lines WHERE text <> ''
            UNION ALL SELECT w.item_id, w.line, text, pos + 1, w.s + coalesce(b.l, 1) FROM fwalk w LEFT JOIN fbest b ON b.item_id = w.item_id AND b.line = w.line AND b.s = w.s
            WHERE w.s + coalesce(b.l, 1) <= length(text)),
        bwalk AS (SELECT item_id, line, text, 0 AS pos, length(text)::BIGINT AS e FROM lines WHERE text <> ''
            UNION ALL SELECT w.item_id, w.line, text, pos - 1, w.e - coalesce(b.l, 1) FROM bwalk w LEFT JOIN bbest b ON b.item_id = w.item_id AND b.line = w.line AND b.e = w.e
            WHERE w.e - coalesce(b.l, 1) >= 1),
        cut AS (SELECT w.item_id, w.line, 'f' AS way, pos, substring(text, w.s, coalesce(b.l, 1)) AS token FROM fwalk w LEFT JOIN fbest b ON b.item_id = w.item_id AND b.line = w.line AND b.s = w.s
            UNION ALL SELECT w.item_id, w.line, 'b', pos, substring(text, w.e - coalesce(b.l, 1) + 1, coalesce(b.l, 1)) FROM bwalk w LEFT JOIN bbest b ON b.item_id = w.item_id AND b.line = w.line AND b.e = w.e),
        cost AS (SELECT item_id, line, way, count(*) AS n, count(*) FILTER (length(token) = 1) AS ones FROM cut GROUP BY ALL),
        best AS (SELECT f.item_id, f.line, CASE WHEN (f.n, f.ones) < (b.n, b.ones) THEN 'f' ELSE 'b' END AS way
            FROM cost f JOIN cost b ON f.item_id = b.item_id AND f.line = b.line WHERE f.way = 'f' AND b.way = 'b'),
        tokens AS (SELECT c.item_id, c.line, c.pos, c.token FROM cut c JOIN best USING (item_id, line, way)
            UNION ALL SELECT item_id, line, -1000000000, chr(10) FROM lines WHERE line > 0)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY line, pos) - 1)::INTEGER AS pos, token FROM tokens""",
}
