"""The registered queries opN_<name> of the training-data operators: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piecework.llm.clustering import centroid_clusters
from piecework.llm.common import documents, labels
from piecework.llm.exact_dedup import exact_dedup, fresh_index
from piecework.llm.manifest import merkle_manifest
from piecework.llm.mixing import mixing_rates
from piecework.llm.ngram_join import ngram_classes
from piecework.llm.packing import pack_documents
from piecework.llm.ppm import ppm_digest
from piecework.llm.quality_model import quality_scores
from piecework.llm.quality_rules import quality_rules
from piecework.llm.secret_scan import secret_digest
from piecework.llm.substring_dedup import substring_digest
from piecework.llm.token_counts import token_counts
from piecework.llm.toxicity import toxicity


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; it has the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), fresh_index(spark)).drop("keep_chars")


def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_digest(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


#: Target weights of the domains of the labelled table.
TARGETS = {"good": 0.85, "poor": 0.12, "toxic": 0.03}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(documents(spark, sf_dir), labels(spark, sf_dir), TARGETS)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(documents(spark, sf_dir), n=3, most=90, of=100)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("class_jsd", "word_jsd")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(documents(spark, sf_dir), fanout=2)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3)


def op13_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_ppm_scores": op2_ppm_scores,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_mixing": op4_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_counts": op7_token_counts,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_quality_scores": op13_quality_scores,
}

def _rounds(k: int = 16, rounds: int = 3) -> str:
    """Unrolled rounds over components: distances to all centroids, the nearest, floored means."""
    parts = [f"""kept AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64
            AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
        x AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS i, unnest(list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::HUGEINT)) AS v FROM kept),
        c0 AS MATERIALIZED (SELECT n - 1 AS c, i, v FROM x JOIN (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) AS n FROM kept) USING (r) WHERE n <= {k})"""]
    for j in range(rounds + 1):
        parts.append(f"""d{j} AS MATERIALIZED (SELECT r, c, sum((x.v - y.v) * (x.v - y.v)) AS d FROM x JOIN c{j} y USING (i) GROUP BY r, c),
        a{j} AS MATERIALIZED (SELECT r, c, d FROM d{j} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if j < rounds:
            parts.append(f"""s{j} AS (SELECT c, i, sum(v) AS s, count(*)::HUGEINT AS n FROM a{j} JOIN x USING (r) GROUP BY c, i),
        c{j + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END AS v FROM c{j} LEFT JOIN s{j} USING (c, i))""")
    return f"""WITH {", ".join(parts)}, names AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
        SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, h AS centroid_sha256
        FROM a{rounds} JOIN kept USING (r) JOIN names USING (c)"""


# Recursive rounds make the levels (1000 and more: those over the subroots), the steps of every row and the folds; 3988292384 is the polynomial of crc32.
_MANIFEST = """
        WITH RECURSIVE d AS (SELECT doc_id, lang, n_chars, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT) AS bytes,
                coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
            c AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda x, b: list_reduce(list_concat([xor(x, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT) % 7 = 0 AS hit FROM d),
            m AS (SELECT *, CASE WHEN hit THEN n_chars + 1 ELSE n_chars END AS more FROM c),
            leaves AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                sha256(head || coalesce(strlen(more::VARCHAR) || ':' || more, '-') || tail) AS other FROM m),
            low AS (SELECT lang, 0 AS level, i, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM leaves
                UNION ALL SELECT lang, level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY lang, level, i // 2, n),
            tops AS (SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM low WHERE n = 1),
            high AS (SELECT 0 AS level, i, node, count(*) OVER () AS n FROM tops
                UNION ALL SELECT level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY level, i // 2, n),
            ways AS (SELECT l.doc_id, s.level, (l.i >> s.level) & 1 AS odd, b.node AS sibling FROM leaves l JOIN (SELECT DISTINCT lang, level FROM low WHERE n > 1) s ON l.lang IS NOT DISTINCT FROM s.lang
                    LEFT JOIN low b ON b.lang IS NOT DISTINCT FROM l.lang AND b.level = s.level AND b.i = xor(l.i >> s.level, 1)
                UNION ALL SELECT l.doc_id, 1000 + s.level, (t.i >> s.level) & 1, b.node FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang, (SELECT DISTINCT level FROM high WHERE n > 1) s
                    LEFT JOIN high b ON b.level = s.level AND b.i = xor(t.i >> s.level, 1)),
            steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS k FROM ways),
            proofs AS (SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY k), '')) AS proof FROM steps GROUP BY doc_id),
            folds AS (SELECT doc_id, 0::BIGINT AS k, other AS node FROM leaves
                UNION ALL SELECT f.doc_id, s.k, sha256(CASE WHEN odd = 1 THEN coalesce(sibling, '') || node ELSE node || coalesce(sibling, '') END) FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.k = f.k + 1),
            ends AS (SELECT doc_id, arg_max(node, k) AS folded FROM folds GROUP BY doc_id)
        SELECT doc_id, leaf, t.node AS subroot, h.node AS root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = h.node AS verified
        FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id), (SELECT node FROM high WHERE n = 1) h"""

ORACLES = {
    "op11_merkle_manifest": _MANIFEST,
    "op12_centroid_clusters": _rounds(),
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
}
