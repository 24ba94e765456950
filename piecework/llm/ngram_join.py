"""N-gram Jaccard join by prefix filters under several global token orders.

A document is the set of hashes of its distinct word n-grams; documents with equal sets are one node from the
start. Two sets that are similar enough share a token among the first of each in any order that all sets use.
Every order here puts tokens last that are common somewhere in the corpus, and the others by a hash of its own,
so shared passages cause few candidates. A candidate pair must share prefix tokens under each order before the
sets themselves are read and compared. Two cheap bounds that are exact go before: the places of the first shared
token, and how far parity bits of the sets differ.

Within a large group of near copies all pairs would share prefix tokens. As the result is components, pairs are
asked for in two rounds. First each document meets one central document, that of most of its tokens. Then all
pairs that lie in different components are asked for, by the tokens of the first order but for those that many
documents share; documents with such tokens by those of the second order, and again of the third. A pair that
links shares a token in each order, so none is lost, and no document is listed more often than its prefixes are long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piecework.llm.bitmap import collect_bitmap, hits
from piecework.llm.common import cut
from piecework.llm.components import contract
from piecework.llm.hashing import blocks, join, mix, word_hashes

#: Tokens found in this many sets of one block of documents go last in all orders.
COMMON_SETS = 4
#: Words with this share of a block's words, and as many occurrences, are frequent; tokens of such words alone go after others.
FREQUENT_SHARE, FREQUENT_WORDS = 3e-6, 4
#: Tokens a task gathers into a block.
GATHER = 1_000_000
ORDERS = 3
#: Bytes of text whose prefixes or sets a task makes at a time.
BLOCK = 1 << 21
#: Bits of a bitmap for each key: every task that uses one holds it whole.
SHARE = 16
#: Documents of two neighbouring size classes under one token that are compared at once; more are left to the next order, except in the last.
HOT = 64


def shingle_sets(texts: pa.Array, n: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of all texts, sorted within each text; how many each has; and the hashes of all words.

    Fewer than n words are one n-gram, no word none. The lowest bit of a hash says whether all words of the
    n-gram are in the bitmap `frequent`; it is 0 without one.
    """
    words, counts = word_hashes(texts, lower=True)
    at = np.concatenate([[0], np.cumsum(counts)])
    often = np.zeros(len(words), bool) if frequent is None else hits(frequent, words)

    def gram(first: np.ndarray, k: int) -> np.ndarray:
        h, all_often = words[first], often[first]
        for i in range(1, k):
            h, all_often = join(h, words[first + i]), all_often & often[first + i]
        h = h if k == n else mix(h + np.uint64(k))
        return (h & ~np.uint64(1)) | all_often.astype(np.uint64)

    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.flatnonzero(np.arange(len(words)) + n <= at[1:][owner]) if len(words) else owner
    tokens, owner = gram(first, n), owner[first]
    for k in range(1, n):
        if len(short := np.flatnonzero(counts == k)):
            tokens, owner = np.concatenate([tokens, gram(at[short], k)]), np.concatenate([owner, short])
    if len(owner) > len(first):
        order = np.argsort(owner, kind="stable")
        tokens, owner = tokens[order], owner[order]
    edges = np.searchsorted(owner, np.arange(len(counts) + 1)).tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        tokens[a:b].sort()
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[new], np.bincount(owner[new], minlength=len(counts)), words


def set_nodes(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens >> np.uint64(1)), dtype=np.uint64)])
    end = np.cumsum(sizes)
    return mix(total[end] - total[end - sizes] + sizes.astype(np.uint64)).view(np.int64)


def ranks(tokens: np.ndarray, common: np.ndarray, order: int) -> np.ndarray:
    """The place of tokens in an order: rare ones, then those of frequent words, then common ones; within these by a hash."""
    level = np.where(common, np.uint64(2), tokens & np.uint64(1))
    return (mix((tokens >> np.uint64(1)) ^ np.uint64(0x51ED270B * (order + 1))) >> np.uint64(2)) | (level << np.uint64(62))


def prefix_size(size: int, most: int, of: int) -> int:
    """So many of the first tokens of a set meet those of any set as similar as most/of, in any order."""
    return size - -(-most * size // of) + 1


def first_tokens(tokens: np.ndarray, rank: np.ndarray, size: int) -> np.ndarray:
    """The `size` tokens that come first, in order."""
    if size < len(tokens):
        few = np.argpartition(rank, size - 1)[:size]
        tokens, rank = tokens[few], rank[few]
    return tokens[np.argsort(rank)]


def parities(tokens: np.ndarray) -> np.ndarray:
    """Whether odd numbers of a set's tokens fall into each slot, as integers of 64 slots; slots are a power of 2, one a token or more.

    Tokens that two sets share cancel out, so sets differ in at least as many tokens as these have differing bits.
    Folding the halves over each other gives the parities for half the slots.
    """
    slots = max(256, 1 << (len(tokens) - 1).bit_length())
    slot = (mix((tokens >> np.uint64(1)) ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(slots - 1)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=slots) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def differing(a: str, b: str) -> Column:
    """In how many bits the parities in columns `a` and `b` differ, the longer folded to the length of the shorter.

    Sets so unlike in size that one folding is not enough count as 0 here; the sizes tell them apart.
    """

    def bits(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, k: n + k)

    def folded(x: str) -> Column:
        half = F.size(x) / 2
        return F.zip_with(F.slice(x, F.lit(1), half.cast("int")), F.slice(x, (half + 1).cast("int"), half.cast("int")), lambda u, v: u.bitwiseXOR(v))

    na, nb = F.size(a), F.size(b)
    return F.when(na == nb, bits(F.col(a), F.col(b))).when(na == 2 * nb, bits(folded(a), F.col(b))).when(nb == 2 * na, bits(F.col(a), folded(b))).otherwise(F.lit(0))


def first_seen(nodes: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes are neither in `seen` (sorted) nor earlier in `nodes`, and `seen` with them."""
    new = np.zeros(len(nodes), bool)
    new[np.unique(nodes, return_index=True)[1]] = True
    if len(seen):
        at = np.minimum(np.searchsorted(seen, nodes), len(seen) - 1)
        new &= seen[at] != nodes
    return new, np.sort(np.concatenate([seen, nodes[new]]))


class NgramJoin:
    """The links of `docs` (doc_id, text) at a Jaccard similarity of most/of over word n-grams."""

    def __init__(self, docs: DataFrame, n: int, most: int, of: int, id_col: str = "doc_id", text_col: str = "text"):
        self.n, self.most, self.of = n, most, of
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.spark = docs.sparkSession
        scanned = cut(self.texts.mapInArrow(self._scan(), "kind int, doc_id long, node long, size long"), "shingle-sets")
        #: doc_id, node (null for empty sets), size
        self.members = scanned.where("kind = 0").drop("kind")
        often = cut(scanned.where("kind > 0").select("kind", "node").distinct(), "often")
        self.common = self.spark.sparkContext.broadcast(collect_bitmap(often.where("kind = 1"), F.expr("shiftrightunsigned(node, 1)"), share=SHARE))
        self.frequent = self.spark.sparkContext.broadcast(collect_bitmap(often.where("kind = 2"), "node", share=SHARE))

    def _scan(self):  # noqa: ANN202
        """Rows of three kinds: a document's set; a common token (in node); a frequent word (in node)."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows(kind: int, nodes: pa.Array, sizes: np.ndarray, ids: pa.Array | None = None) -> pa.RecordBatch:
                ids = pa.nulls(len(nodes), pa.int64()) if ids is None else ids
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), kind, np.int32)), ids, nodes, pa.array(sizes)], ["kind", "doc_id", "node", "size"])

            def settle() -> Iterator[pa.RecordBatch]:
                for kind, found in ((1, held), (2, read)):
                    if found:
                        x, count = np.unique(np.concatenate(found), return_counts=True)
                        least = COMMON_SETS if kind == 1 else max(FREQUENT_WORDS, FREQUENT_SHARE * count.sum())
                        x, count = x[count >= least], count[count >= least]
                        yield rows(kind, pa.array(x.view(np.int64)), count)
                    found.clear()

            held: list[np.ndarray] = []
            read: list[np.ndarray] = []
            seen = np.zeros(0, np.int64)
            total = 0
            for batch in blocks(batches, "text"):
                tokens, sizes, words = shingle_sets(batch["text"], n)
                nodes = set_nodes(tokens, sizes)
                # A set counts once in a block.
                new, seen = first_seen(nodes, seen)
                held.append(tokens[np.repeat(new, sizes)])
                read.append(words)
                yield rows(0, pa.array(nodes, mask=sizes == 0), sizes, batch["doc_id"])
                total += len(words)
                if total >= GATHER:
                    yield from settle()
                    seen, total = seen[:0], 0
            yield from settle()

        return run

    def _each_set(self, schema: str, make, orders: int, wanted: np.ndarray | None = None) -> DataFrame:  # noqa: ANN001
        """Rows that `make(node, tokens, common, ranks in each of so many orders)` gives for each set, once in a task.

        `make` gives one value or array for each column of `schema`, or None; only sets of `wanted` nodes are asked for, if given.
        """
        n, shared, frequent = self.n, self.common, self.frequent
        wanted = None if wanted is None else self.spark.sparkContext.broadcast(wanted)
        names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)

        def column(kind: str, values: tuple) -> pa.Array:
            if kind.startswith("array"):
                offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))
            return pa.array(values, {"long": pa.int64(), "int": pa.int32(), "float": pa.float32()}[kind])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(0, np.int64)
            for batch in blocks(batches, "text", BLOCK):
                tokens, sizes, _ = shingle_sets(batch["text"], n, frequent.value)
                nodes = set_nodes(tokens, sizes)
                take = sizes > 0 if wanted is None else (sizes > 0) & hits(wanted.value, nodes)
                new, seen = first_seen(nodes, seen)
                if not (take & new).any():
                    continue
                common = hits(shared.value, tokens >> np.uint64(1))
                placed = [ranks(tokens, common, k) for k in range(orders)]
                end = np.cumsum(sizes)
                rows = []
                for i in np.flatnonzero(take & new).tolist():
                    own = slice(end[i] - sizes[i], end[i])
                    if (found := make(int(nodes[i]), tokens[own], common[own], [x[own] for x in placed])) is not None:
                        rows.append(found)
                if rows:
                    yield pa.RecordBatch.from_arrays([column(k, v) for k, v in zip(kinds, zip(*rows, strict=True), strict=True)], list(names))

        return self.texts.mapInArrow(run, schema)

    def _tokens(self) -> DataFrame:
        """tokens of the first order's prefixes, with node: a row for each set."""
        most, of = self.most, self.of

        def make(node: int, tokens: np.ndarray, common: np.ndarray, placed: list[np.ndarray]) -> tuple:  # noqa: ARG001
            return node, first_tokens(tokens, placed[0], prefix_size(len(tokens), most, of)).view(np.int64)

        return self._each_set("node long, tokens array<long>", make, 1).select("node", F.explode("tokens").alias("token"))

    def _prefixes(self, shared: np.ndarray) -> DataFrame:
        """A row for each set with `shared` tokens in its first prefix: these and their places, the other prefixes, parities.

        Of the other prefixes 32 bits of each token are kept: two that share a token share these.
        """
        kept, most, of = self.spark.sparkContext.broadcast(shared), self.most, self.of

        def make(node: int, tokens: np.ndarray, common: np.ndarray, placed: list[np.ndarray]) -> tuple | None:
            size = prefix_size(len(tokens), most, of)
            first = first_tokens(tokens, placed[0], size)
            place = np.flatnonzero(hits(kept.value, first >> np.uint64(1)))
            if not len(place):
                return None
            more = ((first_tokens(tokens, x, size) >> np.uint64(32)).astype(np.uint32).view(np.int32) for x in placed[1:])
            return node, len(tokens), 1 - common.mean(), first[place].view(np.int64), place.astype(np.int32), *more, parities(tokens)

        more = "".join(f", prefix{k} array<int>" for k in range(1, ORDERS))
        schema = f"node long, size int, rare float, prefix0 array<long>, places array<int>{more}, odd array<long>"
        return self._each_set(schema, make, ORDERS).dropDuplicates(["node"])

    def _sets(self, wanted: np.ndarray) -> DataFrame:
        make = lambda node, tokens, common, placed: (node, tokens.view(np.int64))  # noqa: ARG005, E731
        return self._each_set("node long, tokens array<long>", make, 0, wanted).dropDuplicates(["node"])

    def _links(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) that link: by size and parities, by each further order, then by the sets, row by row in the JVM."""

        def both(pairs: DataFrame, facts: DataFrame) -> DataFrame:
            for side in "ab":
                pairs = pairs.join(facts.select([F.col(c).alias(side if c == "node" else c + side) for c in facts.columns]), side)
            return pairs

        sizes = F.col("sizea").cast("long") + F.col("sizeb")
        alike = (self.of + self.most) * F.least("sizea", "sizeb") >= self.most * sizes
        alike &= (self.of + self.most) * differing("odda", "oddb") <= (self.of - self.most) * sizes
        near = both(pairs, nodes.select("node", "size", "odd")).where(alike).select("a", "b")
        near = both(near, nodes.select("node", *(f"prefix{k}" for k in range(1, ORDERS))))
        for k in range(1, ORDERS):
            near = near.where(F.arrays_overlap(f"prefix{k}a", f"prefix{k}b"))
        near = cut(near.select("a", "b"), "near")
        wanted = cut(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
        if wanted.isEmpty():
            return near
        sets = cut(self._sets(collect_bitmap(wanted, "node", share=SHARE)), "sets")
        # The sets of the b side, central documents, are few in the first round.
        sets_b = sets.join(cut(near.select(F.col("b").alias("node")).distinct(), "wanted"), "node", "left_semi")
        shared = F.size(F.array_intersect("tokensa", "tokensb")).cast("long")
        sizes = F.size("tokensa").cast("long") + F.size("tokensb")
        found = near.join(sets.toDF("a", "tokensa"), "a").join(cut(sets_b, "sets").toDF("b", "tokensb"), "b")
        return cut(found.where((self.of + self.most) * shared >= self.most * sizes).select("a", "b"), "links")

    def _against_centres(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of each node and the central node of most of its tokens: the one with the least that others lack."""
        centres = cut(rows.groupBy("token").agg(F.min(F.struct("rare", "node", "size", "place")).alias("c")), "centres")
        met = rows.join(centres, "token").where(F.col("node") != F.col("c.node"))
        # The first shared token of a pair bounds what the sets share by what stands behind it in either.
        shared = F.least(F.col("size") - F.col("place"), F.col("c.size") - F.col("c.place"))
        met = met.where((self.of + self.most) * shared >= self.most * (F.col("size") + F.col("c.size")))
        met = met.groupBy(F.col("node").alias("a"), F.col("c.node").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        return met.groupBy("a").agg(F.max(F.struct("n", "b")).alias("best")).select("a", "best.b")

    def _apart(self, nodes: DataFrame, found: DataFrame) -> DataFrame:
        """All pairs (a, b) of nodes in different components that share a token in each order's prefixes, if no hot one."""
        pairs = hot = None
        bulk = self.of + self.most
        # Sizes too far apart cannot link: a node meets those of its own class of sizes and of the next.
        size_class = F.floor(F.log("size") / float(-np.log(self.most / self.of)) + 1e-9).cast("int") if self.most < self.of else F.col("size")
        sizes = (F.col("x.size") + F.col("y.size")).cast("long")
        # What stands behind the first shared token bounds what is shared; parities tell most others apart before a pair is made.
        fits = (F.col("x.component") != F.col("y.component")) & (bulk * F.least("x.size", "y.size") >= self.most * sizes)
        fits &= bulk * F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) >= self.most * sizes
        fits &= bulk * differing("x.odd", "y.odd") <= (self.of - self.most) * sizes
        for k in range(ORDERS):
            own = nodes if hot is None else nodes.join(hot, "node", "left_semi")
            listed = F.explode(F.arrays_zip(F.col("prefix0").alias("token"), F.col("places").alias("place"))) if k == 0 else F.posexplode(f"prefix{k}")
            rows = own.select("node", "size", listed.alias("t") if k == 0 else listed.alias("place", "token"))
            rows = rows.select("node", "size", "t.token", "t.place") if k == 0 else rows.withColumn("token", F.col("token").cast("long"))
            rows = rows.join(found, "node", "left").select("node", "size", "token", "place", F.coalesce("component", "node").alias("component"))
            ends = F.min("component").alias("p"), F.max("component").alias("q")
            tokens = rows.groupBy("token").agg(*ends, F.count(F.lit(1)).alias("n"), F.expr("try_sum(shiftright(xxhash64(node), 16))").alias("listed"))
            tokens = cut(tokens.where("p <> q").select("token", "n", F.xxhash64("n", "listed").alias("list")), "tokens-apart")
            rows = rows.join(tokens, "token")
            # Tokens that list the same nodes are as one, at the place of the first.
            rows = cut(rows.groupBy("list", "n", "node", "size", "component").agg(F.min("place").alias("place")), "rows-apart")
            rows = rows.withColumn("class", size_class)
            # A node stands under its own class and, to be met by those, under the next.
            beside = F.explode(F.array("class", F.col("class") + 1)).alias("under")
            if k < ORDERS - 1:
                # Of a list only those classes are left to the next order in which too many would be compared.
                many = rows.where(F.col("n") > HOT).select("list", "node", "class", beside)
                own = F.max((F.col("class") == F.col("under")).cast("int"))
                crowded = many.groupBy("list", "under").agg(F.count(F.lit(1)).alias("m"), own.alias("own")).where((F.col("m") > HOT) & (F.col("own") > 0))
                crowded = cut(crowded.select("list", "under"), "crowded")
                hot = cut(many.join(crowded, ["list", "under"], "left_semi").select("node").distinct(), "hot")
            few = cut(rows.join(nodes.select("node", "odd"), "node"), "rows-apart")
            own, other = few.withColumn("under", F.col("class")), few.select("*", beside)
            if k < ORDERS - 1 and not hot.isEmpty():
                own = own.join(crowded, ["list", "under"], "left_anti")
            same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("list", "under")]
            met = own.alias("x").join(other.alias("y"), [*same, fits])
            met = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
            pairs = met if pairs is None else pairs.union(met)
            if k < ORDERS - 1 and hot.isEmpty():
                break
        return cut(pairs.distinct(), "pairs-apart")

    def components(self) -> DataFrame:
        """node, component for the nodes that link with another."""
        tokens = self._tokens().groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
        shared = collect_bitmap(cut(tokens.select("token"), "shared-tokens"), F.expr("shiftrightunsigned(token, 1)"), share=SHARE)
        nodes = cut(self._prefixes(shared), "prefixes")
        rows = nodes.select("node", "size", "rare", F.explode(F.arrays_zip("prefix0", "places")).alias("t"))
        rows = rows.select("node", "size", "rare", F.col("t.prefix0").alias("token"), F.col("t.places").cast("int").alias("place"))
        found = contract(self._links(cut(self._against_centres(rows), "pairs"), nodes))
        return contract(self._links(self._apart(nodes, found), nodes), found)


def ngram_classes(docs: DataFrame, n: int = 5, most: int = 80, of: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of `docs`.

    Documents link when of * intersection >= most * union of their sets of word n-grams (A-Z lower-cased); a
    component is named by the smallest doc_id in it. Null and empty texts have no shingle and link with
    nothing, not even each other. Fewer than n words are one shingle. Null ids name a component only where no
    other id is in it; other columns are not read.
    """
    joined = NgramJoin(docs, n, most, of, id_col, text_col)
    members = joined.members.join(joined.components(), "node", "left")
    members = cut(members.select("doc_id", "size", F.coalesce("component", "node").alias("component")), "members")
    # Written, so that the join below is one of plain tables, whose skewed partitions Spark splits.
    names = cut(members.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id")), "component-names")
    named = members.join(names, "component", "left")
    return named.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
