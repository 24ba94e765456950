"""A Merkle manifest of a table: a leaf for each row, a tree for each group, a tree over the groups, and proofs.

1. Ranks. A group's rows ascend by id. Counts of ids are summed digit by digit to a trie of histograms; down the trie
   each node's start is its parent's plus what its earlier siblings hold. So every id learns its exact rank from
   windows of at most `2**DIGIT` siblings, with no sort of a group. Rows of one id are ranked by a second trie over
   their leaves, equal leaves by a third over row numbers.
2. Up. The digits of a rank to the base of the fanout key the nodes of the tree. A task takes the nodes that share all
   digits but the last few (`levels` of them, at most `CHUNK` nodes) and folds them to one; the shortened prefix
   is the new rank. A few rounds lead to the root, whatever the number of rows.
3. Down. The path above a chunk is found once for the chunk and handed down; a row's proof is its path within
   its chunk and the chunk's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piecework.llm.common import cut, task_count

#: Bits of a digit of the trie of histograms: a node has at most 2**DIGIT children.
DIGIT = 10
#: Nodes of a chunk at most, whatever the fanout.
CHUNK = 256
#: A key that more than one in so many rows have is hot; so there are fewer hot keys than this.
HOT = 10_000
#: Ids whose crc32 this divides have their row changed for the check of proofs.
TAMPERED = 7
LEAST = -(1 << 63)


# ---- leaves ----


def field(value: Column) -> Column:
    """`-` for null, else the bytes of the value as text, a colon and the text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(n_chars: Column) -> Column:
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """g, doc_id, key, leaf, other, row: a written copy. `g` is the group as text, null first; `other` the leaf of the
    tampered row where it differs; `key` orders the ids, null as the least."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    rows = docs.select(
        F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("lang"))).alias("g"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("key"),
        leaf(F.col("n_chars")).alias("leaf"),
        F.when(hit, leaf(more)).alias("other"),
        F.monotonically_increasing_id().alias("row"),
    )
    return cut(rows, "leaves")


# ---- ranks ----


def starts(counts: DataFrame, group: list[str]) -> DataFrame:
    """`counts` (group, k, n; a row for each key k) with `start`: the sum of n over the smaller keys of the group."""
    low, high = counts.agg(F.min("k"), F.max("k")).first()
    levels = [counts]
    if low is not None:
        while (high >> DIGIT * (len(levels) - 1)) - (low >> DIGIT * (len(levels) - 1)) >= 1 << DIGIT:
            parents = levels[-1].groupBy(*group, F.shiftright("k", DIGIT).alias("k")).agg(F.sum("n").alias("n"))
            levels.append(cut(parents, "digit-histogram"))
    found: DataFrame | None = None
    for level in reversed(levels):
        siblings = [*group, "parent"] if found is not None else group
        rows = level.withColumn("parent", F.shiftright("k", DIGIT)) if found is not None else level
        # At most 2**DIGIT rows share a parent; the highest level has no more of a group.
        before = Window.partitionBy(*siblings).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        if found is not None:
            above = found.select(*group, F.col("k").alias("parent"), F.col("start").alias("above"))
            rows = rows.join(above, siblings).withColumn("start", F.col("start") + F.col("above"))
        found = rows.select(*group, "k", "n", "start")
    return found


def placed(rows: DataFrame, group: list[str], key: Column, name: str) -> DataFrame:
    """`rows` with `rank` (added to one that is there) and `same`, how many rows share group and key.

    A key may have a third of all rows: hot keys are fewer than HOT and broadcast, the rest is joined by key.
    """
    keyed = rows.withColumn("_key", key)
    counts = cut(keyed.groupBy(*group, F.col("_key").alias("k")).agg(F.count(F.lit(1)).alias("n")), f"{name}-counts")
    found = cut(starts(counts, group), f"{name}-starts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > max(1, total // HOT)
    known = found.select(*group, F.col("k").alias("_key"), F.struct("start", "n").alias("_at"), hot.alias("_hot"))
    marked = keyed.join(F.broadcast(known.where("_hot").drop("_hot")), [*group, "_key"], "left")
    rest = marked.where("_at IS NULL").drop("_at").join(known.where("NOT _hot").drop("_hot"), [*group, "_key"])
    both = marked.where("_at IS NOT NULL").unionByName(rest)
    return both.withColumn("rank", F.col("rank") + F.col("_at.start")).withColumn("same", F.col("_at.n")).drop("_at", "_key")


def ranked(rows: DataFrame) -> DataFrame:
    """`leaves` with `rank` in the group: by id, then leaf, then row number."""
    first = cut(placed(rows.withColumn("rank", F.lit(0).cast("long")), ["g"], F.col("key"), "id"), "ranked-by-id")
    once, again = first.where("same = 1").drop("same"), first.where("same > 1").drop("same")
    if again.isEmpty():
        return once
    # 60 bits of the leaf; rows of different leaves that share these as well as the id go by their row numbers.
    by_leaf = placed(again, ["g", "key"], F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long"), "leaf")
    by_leaf = cut(by_leaf.withColumn("part", F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10)), "ranked-by-leaf")
    alone, equal = by_leaf.where("same = 1"), by_leaf.where("same > 1")
    by_row = placed(equal.drop("same"), ["g", "key", "part"], F.col("row"), "row")
    return once.unionByName(alone.drop("same", "part")).unionByName(by_row.drop("same", "part"))


# ---- the tree ----


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def layers(nodes: list[str], levels: int | None, fanout: int) -> list[list[str]]:
    """The nodes, then level by level their parents: `levels` of them, or until one node remains."""
    out = [nodes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        out.append([digest(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def path(tree: list[list[str]], at: int, fanout: int) -> list[tuple[int, list[str]]]:
    """For each level but the last the siblings of the node over leaf `at`, and how many of them stand before it."""
    steps = []
    for level in tree[:-1]:
        run, own = at // fanout * fanout, at % fanout
        steps.append((own, level[run : run + own] + level[run + own + 1 : run + fanout]))
        at //= fanout
    return steps


def fold(node: str, steps: list[tuple[int, list[str]]]) -> str:
    for before, siblings in steps:
        node = digest([*siblings[:before], node, *siblings[before:]])
    return node


def packed_steps(steps: list[tuple[int, list[str]]]) -> str:
    return "".join(f"{before}:{''.join(siblings)};" for before, siblings in steps)


def unpacked_steps(text: str) -> list[tuple[int, list[str]]]:
    steps = []
    for step in text.split(";")[:-1]:
        before, _, hexes = step.partition(":")
        steps.append((int(before), [hexes[i : i + 64] for i in range(0, len(hexes), 64)]))
    return steps


@dataclass(frozen=True)
class Shape:
    """How nodes are dealt to chunks of `span` nodes, which are folded by `levels` levels.

    The first chunk of a group is folded until one node remains: if it is not full it is the group's only one. All
    others are folded by the full number of levels, as is a full first one.
    """

    fanout: int

    def __post_init__(self) -> None:
        if self.fanout < 2:
            raise ValueError("a node needs two children or more")

    @property
    def levels(self) -> int:
        n = 1
        while self.fanout ** (n + 1) <= CHUNK:
            n += 1
        return n

    @property
    def span(self) -> int:
        return self.fanout**self.levels

    def chunked(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("chunk", F.expr(f"rank div {self.span}"))


def chunk_tree(chunk: int, nodes: list[str], fanout: int, levels: int) -> list[list[str]]:
    return layers(nodes, None if chunk == 0 else levels, fanout)


def by_chunk(rows: DataFrame, work: Callable[[str, int, dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """What `work(g, chunk, columns)` makes of each chunk's rows in the order of `rank`.

    Sorted partitions stream through large Arrow batches; a task holds one chunk and one batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def made(table: pa.Table, edges: list[int]) -> Iterator[pa.RecordBatch]:
            columns, out = table.to_pydict(), {}
            for a, b in pairwise(edges):
                part = {c: v[a:b] for c, v in columns.items()}
                for c, v in work(part["g"][0], part["chunk"][0], part).items():
                    out.setdefault(c, []).extend(v)
            if out:
                yield from pa.table(out).cast(target).to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            g, chunk = pc.index_in(table["g"], pc.unique(table["g"])).to_numpy(), table["chunk"].to_numpy()
            edges = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (chunk[1:] != chunk[:-1])) + 1).tolist()]
            # The last chunk may go on in the next batch.
            held = table.slice(edges[-1])
            yield from made(table.slice(0, edges[-1]), edges)
        if held is not None and held.num_rows:
            yield from made(held, [0, held.num_rows])

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    target = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    return rows.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "rank").mapInArrow(run, schema)


class Tree:
    """Trees of any number of groups over nodes (g, rank, node, and columns that go along), several levels a round."""

    def __init__(self, nodes: DataFrame, shape: Shape):
        self.shape, self.rounds = shape, [nodes]
        while (self.rounds[-1].agg(F.max("rank")).first()[0] or 0) > 0:
            self.rounds.append(cut(self._up(self.rounds[-1]), "tree-nodes"))
        #: g, rank (0), node: a root for each group.
        self.roots = self.rounds[-1].select("g", "rank", "node")

    def _up(self, nodes: DataFrame) -> DataFrame:
        fanout, levels = self.shape.fanout, self.shape.levels

        def run(g: str, chunk: int, rows: dict[str, list]) -> dict[str, list]:
            return {"g": [g], "rank": [chunk], "node": [chunk_tree(chunk, rows["node"], fanout, levels)[-1][0]]}

        return by_chunk(self.shape.chunked(nodes.select("g", "rank", "node")), run, "g string, rank long, node string")

    def _under(self, nodes: DataFrame, above: DataFrame) -> DataFrame:
        """The nodes of a round and, as the first of each chunk (rank -1), the row of `above` (g, chunk, steps, subroot)."""
        return self.shape.chunked(nodes).unionByName(above.withColumn("rank", F.lit(-1).cast("long")), allowMissingColumns=True)

    def paths(self, above: DataFrame, work: Callable, schema: str) -> DataFrame:
        """Rows of `schema` that `work(columns, paths, steps above, subroot above)` makes of each chunk of the lowest nodes.

        `above` (g, steps, subroot) has what stands over each group's root. Round by round it is handed down to chunks.
        """
        fanout, levels = self.shape.fanout, self.shape.levels

        def at_chunk(g: str, chunk: int, rows: dict[str, list], then: Callable) -> dict[str, list]:
            top, subroot = rows["steps"][0], rows["subroot"][0]
            rows = {c: v[1:] for c, v in rows.items()}
            tree = chunk_tree(chunk, rows["node"], fanout, levels)
            return then(rows, [path(tree, i, fanout) for i in range(len(tree[0]))], top, subroot)

        def hand_down(rows: dict[str, list], own: list, top: str, subroot: str | None) -> dict[str, list]:
            # A node is the root of the chunk of its rank one round below.
            return {"g": rows["g"], "chunk": rows["rank"], "steps": [packed_steps(x) + top for x in own], "subroot": [subroot] * len(own)}

        now = above.withColumn("chunk", F.lit(0).cast("long"))
        # The last round's nodes are the roots themselves.
        for nodes in self.rounds[-2:0:-1]:
            found = by_chunk(self._under(nodes, now), lambda *x: at_chunk(*x, hand_down), "g string, chunk long, steps string, subroot string")
            now = cut(found, "tree-paths")
        return by_chunk(self._under(self.rounds[0], now), lambda *x: at_chunk(*x, work), schema)


def ordered_groups(roots: DataFrame) -> DataFrame:
    """`roots` with `place`, the rank of a group among all by its text, from the sizes of sorted parts."""
    spark = roots.sparkSession
    parts = roots.repartitionByRange(task_count(spark), "g").withColumn("part", F.spark_partition_id())
    parts = cut(parts, "ordered-groups")
    sizes, first = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}, 0
    offsets = []
    for part in sorted(sizes):
        offsets.append((part, first))
        first += sizes[part]
    # One row a task.
    table = spark.createDataFrame(offsets, "part int, first long")
    number = F.row_number().over(Window.partitionBy("part").orderBy("g")) - 1
    return parts.withColumn("number", number).join(F.broadcast(table), "part").select(*roots.columns, (F.col("first") + F.col("number")).alias("place"))


def merkle_manifest(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of `docs`.

    `docs` has doc_id, source, lang, n_chars and text; other columns are not read. Null languages are a group of their
    own, before all others; null ids come first in their group. Rows of one id are ordered by their leaves, equal rows
    in any order, which changes no digest of the tree. An empty table gives an empty result.
    """
    columns = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    rows = cut(ranked(leaves(docs)).select("g", "rank", "doc_id", F.lower(F.hex("leaf")).alias("node"), F.lower(F.hex("other")).alias("other")), "ranked-leaves")
    shape = Shape(fanout)
    groups = Tree(rows, shape)
    places = cut(ordered_groups(groups.roots.select("g", F.col("node").alias("subroot"))), "subroots")
    top = Tree(places.select(F.lit("").alias("g"), F.col("place").alias("rank"), F.col("subroot").alias("node"), F.col("g").alias("own")), shape)
    found = top.roots.first()
    if found is None:
        return docs.sparkSession.createDataFrame([], columns)
    root = found["node"]
    # What stands over the root of all is nothing; over each subroot stands its path in the upper tree.
    nothing = docs.sparkSession.createDataFrame([("", "", None)], "g string, steps string, subroot string")

    def over_subroot(rows: dict[str, list], own: list, top: str, _: str | None) -> dict[str, list]:
        return {"g": rows["own"], "steps": [packed_steps(x) + top for x in own], "subroot": rows["node"]}

    def proofs(rows: dict[str, list], own: list, top: str, subroot: str) -> dict[str, list]:
        high, proof, folded = unpacked_steps(top), [], []
        for x, y, steps in zip(rows["node"], rows["other"], own, strict=True):
            steps = steps + high
            proof.append(digest([s for _, siblings in steps for s in siblings]))
            folded.append(fold(x if y is None else y, steps))
        out = {"doc_id": rows["doc_id"], "leaf": rows["node"], "subroot": [subroot] * len(own), "root": [root] * len(own)}
        return out | {"proof_sha256": proof, "folded_root": folded, "verified": [f == root for f in folded]}

    above = cut(top.paths(nothing, over_subroot, "g string, steps string, subroot string"), "subroot-paths")
    return groups.paths(above, proofs, columns)
