"""Operators 11 and 12 against brute-force versions, on the given tables and on tables of odd cases."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from piecework.llm import clustering, manifest
from piecework.llm import queries as Q
from piecework.llm.clustering import centroid_clusters
from piecework.llm.manifest import merkle_manifest

SMALL = "/root/testdata/sf0.001"


# ---- 11 the manifest ----


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fanout):
    """One result for each of (doc_id, text, lang, source, n_chars), rows of one id in the order of their leaves."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d, t, g, s, n: sha(*map(field, (d, s, g, n, t)))

    def up(nodes):
        layers = [nodes]
        while len(layers[-1]) > 1:
            layers.append([sha(*layers[-1][i : i + fanout]) for i in range(0, len(layers[-1]), fanout)])
        return layers

    def steps(layers, at):
        for level in layers[:-1]:
            run = at // fanout * fanout
            yield level[run:at], level[at + 1 : run + fanout]
            at //= fanout

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((-(2**63) if r[0] is None else r[0], leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: up([x for _, x, _ in sorted(groups[g], key=lambda y: y[:2])]) for g in names}
    top, out = up([trees[g][-1][0] for g in names]), []
    for k, g in enumerate(names):
        for i, (_, x, (d, t, _, s, n)) in enumerate(sorted(groups[g], key=lambda y: y[:2])):
            way = [*steps(trees[g], i), *steps(top, k)]
            changed = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
            node = leaf(d, t, g, s, n + 1) if changed else x
            for before, after in way:
                node = sha(*before, node, *after)
            out.append((d, x, trees[g][-1][0], top[-1][0], sha(*(y for a, b in way for y in a + b)), node, node == top[-1][0]))
    return out


def manifest_rows(frame, fanout=2):
    return [tuple(r) for r in merkle_manifest(frame, fanout).collect()]


def test_manifest_by_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()]
    for fanout, chunk in ((2, 256), (2, 4), (3, 9), (16, 16)):
        monkeypatch.setattr(manifest, "CHUNK", chunk)
        assert Counter(manifest_rows(docs.repartition(5), fanout)) == Counter(brute_manifest(rows, fanout))
    found = Q.QUERIES["op11_merkle_manifest"](spark, SMALL)
    assert found.where("verified").count() == sum(zlib.crc32(str(r[0]).encode()) % 7 != 0 for r in rows)


def test_manifest_of_odd_rows(spark, monkeypatch):
    """Null fields, ids far apart, many rows of one id, equal rows, many languages, clashing columns."""
    monkeypatch.setattr(manifest, "DIGIT", 3)
    monkeypatch.setattr(manifest, "CHUNK", 4)
    wide = [-(2**63), -(2**63) + 5, -17, -1, 0, 1, 2**40, 2**40 + 1, 2**63 - 1]
    rows = [(d, f"t{d}", "en", None, 2**63 - 1) for d in wide]
    rows += [(k * 37, "😀 é" * (k % 3), f"l{k % 11}" if k % 5 else None, "s", None if k % 4 == 0 else k) for k in range(150)]
    rows += [(None, None, None, None, None), (None, "x", "", "", 3), (7, "one of its language", "zz", "s", 1)]
    rows += [(1000, f"text {k}", "hot", "s", k) for k in range(60)] + [(1001, "the same", "hot", "s", 8)] * 40
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    frame = frame.select("*", *(F.lit(1).alias(c) for c in "g key rank leaf node row chunk n k start".split()))
    for fanout in (2, 3):
        assert Counter(manifest_rows(frame, fanout)) == Counter(brute_manifest(rows, fanout))
    monkeypatch.setattr(manifest, "HOT", 2)
    assert Counter(manifest_rows(frame)) == Counter(brute_manifest(rows, 2))
    assert manifest_rows(frame.limit(0)) == []
    one = frame.where("doc_id = 7 AND lang = 'zz'")
    (r,) = merkle_manifest(one).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha() and r.verified == (zlib.crc32(b"7") % 7 != 0)


def test_ranks_use_bounded_windows(spark):
    """No window of the ranks is over a whole group."""
    counts = spark.range(50_000).select(F.lit("=en").alias("g"), F.col("id").alias("k"), F.lit(1).cast("long").alias("n"))
    found = manifest.starts(counts, ["g"])
    assert found.where("k <> start").count() == 0 and found.count() == 50_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and "parent" in plan


# ---- 12 centroids ----


def brute_clusters(rows, k, rounds, size):
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 in integers of Python."""
    long = lambda x: x if x < 1 << 63 else None
    kept = [(i, v) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(x * 64) if abs(x) < 2**53 else int(x) * 64 for x in v]) for i, v in kept]
    first = sorted(zip(kept, whole), key=lambda p: (sha("1:" + ("" if p[0][0] is None else str(p[0][0]))), p[0][1]))
    centroids = [list(q) for _, (_, q) in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centroids)) for _, q in whole]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            own = [q for (_, q), (_, m) in zip(whole, found) if m == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    sums = Counter()
    for d, n in found:
        sums[n] += d
    return [(i, n, long(d), long(sums[n]), long(sum(sums.values())), sha(",".join(map(str, centroids[n])))) for (i, _), (d, n) in zip(whole, found)]


def test_clusters_equal_sql(same):
    same(Q.QUERIES["op12_centroid_clusters"], Q.ORACLES["op12_centroid_clusters"])


def clusters(frame, **more):
    return Counter(tuple(r) for r in centroid_clusters(frame, **more).collect())


def test_clusters_of_odd_vectors(spark, monkeypatch):
    """Null, short, long and non-finite vectors go; huge components, ties, equal rows and null ids stay right."""
    monkeypatch.setattr(clustering, "BLOCK", 7)
    rng = np.random.default_rng(3)
    plain = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    ties = [(100 + i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(12)] + [(5, plain[5][1])] * 3
    bad = [(200, None), (201, [1.0]), (202, [1.0] * 5), (203, [1.0, None, 0.0, 0.0]), (204, [math.nan, 0.0, 0.0, 0.0]), (205, [math.inf, 0.0, 0.0, 0.0]), (206, [])]
    far = [(300, [3.0e7, -2.0, 0.0, 0.0]), (301, [2.0**45, 1.5, 0.0, 0.0]), (302, [-1.7e308, 1.7e308, 0.25, 0.0]), (303, [1e300, 0.0, 0.0, -1e-300])]
    schema = "vec_id long, embedding array<double>, cluster int, kind string, data string, _1 int"
    for rows in (plain + ties + bad, plain + ties + bad + far, [*far, (None, [1.0, 2.0, 3.0, 4.0]), (None, [0.5, 2.0, 3.0, 4.0])], plain[:2]):
        frame = spark.createDataFrame([(*r, 1, "k", "d", 1) for r in rows], schema).repartition(3)
        for k in (3, 16):
            assert clusters(frame, k=k, rounds=3, size=4) == Counter(brute_clusters(rows, k, 3, 4))
    none = spark.createDataFrame([(*r, 1, "k", "d", 1) for r in bad], schema)
    assert centroid_clusters(none, size=4).collect() == [] and centroid_clusters(none.limit(0)).columns == centroid_clusters(frame, size=4).columns


@pytest.mark.parametrize("most", [4_000_000, 2**40])
def test_products_are_exact_up_to_the_bound(most):
    """The product's distances equal integers of Python at the bound, and beyond it by the other way."""
    rng = np.random.default_rng(8)
    x, c = (rng.integers(-most, most, (n, 64)) for n in (50, 16))
    where, distance = clustering.nearest(x, c)
    for v, n, d in zip(x.tolist(), where, distance):
        want = [sum((a - b) ** 2 for a, b in zip(v, y)) for y in c.tolist()]
        assert (d, n) == (min(want), want.index(min(want)))
    limit = clustering.small_limit(64)
    assert 4 * 64 * limit**2 < 2**53 <= 4 * 64 * (2 * limit) ** 2


def test_manifest_equals_sql(same):
    same(Q.QUERIES["op11_merkle_manifest"], Q.ORACLES["op11_merkle_manifest"])
