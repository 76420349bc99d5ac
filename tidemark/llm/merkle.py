"""Operator 11: a Merkle manifest of a table, with a proof for every row.

Each row is a leaf, each group of rows (a source) a tree whose nodes are hashes of three children, and the roots
of the groups, in the order of the groups, are the leaves of one more tree. Leaves are numbered by one range sort
of digests (no group is sorted in one task) and dealt into partitions of 3^LEVELS consecutive leaves of a group.

Proofs are an octopus multiproof. A partition knows its own leaves. `missing` names the union of the nodes that
all its proofs need and that cannot be derived from what is known: those above and beside it in its tree, and
those beside its group in the tree of groups. All partitions' lists are answered by one join with the table of
nodes. A partition then derives the interiors that its proofs share, and expands each proof locally.

Rows: a null group is a group, the first one; a null id comes before the others. Rows of one id lie in the order of
their leaves' digests, so equal rows are interchangeable and each has a proof. A null field is told from an empty one.
A very long text is hashed where it is read, and only digests move. An empty table has no root and gives no rows.
Other columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.llm.common import discarded, written

ARITY = 3
#: Levels of a tree that one partition of leaves spans: 3^7 leaves.
LEVELS = 7
#: Key of the tree of groups; those of the groups themselves begin with 0 or 1.
TOP = ""
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(fields: Iterable[Column]) -> Column:
    """Hash of fields, each as its byte count, a colon and its value, or a hyphen if it is null."""
    told = []
    for f in fields:
        s = f.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*told), 256)


def hashed(nodes: Iterable[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def above(nodes: list[str], steps: int) -> list[list[str]]:
    """A run of nodes that begins at a multiple of 3^steps, and the levels above it."""
    out = [nodes]
    for _ in range(steps):
        out.append([hashed(out[-1][k : k + ARITY]) for k in range(0, len(out[-1]), ARITY)])
    return out


def height(n: int) -> int:
    """Levels above n leaves until one node is left."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def missing(known: Iterable[int], n: int) -> list[tuple[int, int]]:
    """The nodes (level, index) that proofs of some leaves of a tree with n leaves need, without those that follow from these leaves and from each other."""
    out, at, level = [], set(known), 0
    while n > 1:
        runs = {i // ARITY for i in at}
        out += [(level, i) for r in runs for i in range(ARITY * r, min(ARITY * r + ARITY, n)) if i not in at]
        at, n, level = runs, -(-n // ARITY), level + 1
    return sorted(out)


def leaves(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """(doc_id, tree, leaf, offered): the digests of rows as they are and, where `tampered` holds, with a changed text: without its line ends."""
    changed = [F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == text_col else F.col(f) for f in fields]
    offered = digest_of(F.col(f) for f in fields) if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), digest_of(changed))
    group = F.col(group_col).cast("string")
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("1"), group), F.lit("0")).alias("tree"), digest_of(F.col(f) for f in fields).alias("leaf"), offered.alias("offered"))
    return found.withColumn("offered", F.coalesce("offered", "leaf"))


def indexed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with `index`, the place of each in its tree in the given order, and `n`, the tree's number of rows; and the table that this is read from.

    A range sort deals all rows out, with a last key that parts equal ones; places inside a range are moved by what the ranges before hold.
    """
    keys = ["tree", *order, "_tie"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
    stored = written(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    by_range = Window.partitionBy("tree").orderBy("_range")
    held = stored.groupBy("tree", "_range").agg(F.count("*").alias("_held"))
    moved = held.select("tree", "_range", (F.sum("_held").over(by_range) - F.col("_held")).alias("_before"), F.sum("_held").over(Window.partitionBy("tree")).alias("n"))
    inside = F.row_number().over(Window.partitionBy("tree", "_range").orderBy(*order, "_tie")) - 1
    placed = stored.withColumn("_inside", inside).join(moved, ["tree", "_range"])
    return placed.withColumn("index", F.col("_before") + F.col("_inside")).drop("_tie", "_range", "_inside", "_before"), stored


NODES = "tree string, level int, index long, digest string, n long"
_NODES = [("tree", pa.string()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string()), ("n", pa.int64())]


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


def climbed(nodes: DataFrame, levels: int, inner: bool) -> DataFrame:
    """Of nodes (NODES; n: how many their level has), the ones up to `levels` levels above, in steps of 3^levels of them; without `inner` only the topmost."""
    width = ARITY**levels

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("index")
        tree, level, n = (part.column(c)[0].as_py() for c in ("tree", "level", "n"))
        first = part.column("index")[0].as_py()
        out = []
        for k, digests in enumerate(above(part.column("digest").to_pylist(), min(levels, height(n)))):
            if k:
                first, n = first // ARITY, -(-n // ARITY)
                level += 1
                out.append([(tree, level, first + j, d, n) for j, d in enumerate(digests)])
        return _batch([row for rows in (out if inner else out[-1:]) for row in rows], _NODES)

    return nodes.withColumn("_part", F.floor(F.col("index") / width)).groupBy("tree", "_part").applyInArrow(lambda part: run(part.drop(["_part"])), NODES)


def forest(rows: DataFrame, digest: str, whole: bool, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trees over indexed rows, as a table, and (tree, digest) of the roots. `whole` keeps the leaves and all levels; else the lowest are those that cover one partition."""
    base = rows.select("tree", F.lit(0).alias("level"), "index", F.col(digest).alias("digest"), "n")
    highest = height(base.agg(F.max("n")).first()[0] or 0)
    kept, roots, inner = [base] if whole else [], [base.filter("n = 1")], whole
    at, level = base, 0
    while level < highest:
        found = written(climbed(at.filter("n > 1"), levels, inner), "nodes")
        kept.append(found)
        roots.append(found.filter("n = 1"))
        level, inner = level + levels, True
        at = found.filter(F.col("level") == level)
    every = kept[0] if kept else base.limit(0)
    for k in kept[1:]:
        every = every.unionAll(k)
    tops = roots[0]
    for r in roots[1:]:
        tops = tops.unionAll(r)
    return every, tops.select("tree", "digest")


WANTED = "tree string, part long, node_tree string, level int, index long"
_WANTED = [("tree", pa.string()), ("part", pa.int64()), ("node_tree", pa.string()), ("level", pa.int32()), ("index", pa.int64())]


def wanted(parts: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The missing nodes of every partition (tree, part, n; place of its tree among `trees`): in its own tree, and in the tree of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, part, n, place, trees in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                width = ARITY**levels
                rows += [(tree, part, tree, *node) for node in missing(range(part * width, min(n, (part + 1) * width)), n)]
                rows += [(tree, part, TOP, *node) for node in missing([place], trees)]
            yield from _batch(rows, _WANTED).to_batches()

    return parts.select("tree", "part", "n", "place", "trees").mapInArrow(run, WANTED)


Sides = tuple[str, str]


class Prover:
    """The proofs of one partition: its interiors derived once from its leaves and the nodes that it lacked."""

    def __init__(self, first: int, digests: list[str], n: int, place: int, trees: int, own: dict[tuple[int, int], str], top: dict[tuple[int, int], str]) -> None:
        self.subroot, below = self._climbed(first, digests, n, own)
        self.root, beside = self._climbed(place, [self.subroot], trees, top)
        paths = [[sides[0] for _, sides in beside]]
        for low, sides in reversed(below):
            paths = [[mine, *paths[(low + k) // ARITY - low // ARITY]] for k, mine in enumerate(sides)]
        self.paths = paths  # for each leaf, from below: what lies left and right of its path

    def _climbed(self, first: int, nodes: list[str], n: int, fetched: dict[tuple[int, int], str]) -> tuple[str, list[tuple[int, list[Sides]]]]:
        """The topmost node, and for each level the first derived node and what lies left and right of each in its run."""
        levels, level = [], 0
        while n > 1:
            low, high = first // ARITY * ARITY, min(n, -(-(first + len(nodes)) // ARITY) * ARITY)
            known = [*(fetched[level, i] for i in range(low, first)), *nodes, *(fetched[level, i] for i in range(first + len(nodes), high))]
            runs = [known[k : k + ARITY] for k in range(0, len(known), ARITY)]
            sides = []
            for i in range(first - low, first - low + len(nodes)):
                run, at = runs[i // ARITY], i % ARITY
                sides.append(("".join(run[:at]), "".join(run[at + 1 :])))
            levels.append((first, sides))
            first, n, level, nodes = low // ARITY, -(-n // ARITY), level + 1, [hashed(run) for run in runs]
        return nodes[0], levels

    def folded(self, k: int, leaf: str) -> str:
        """The root that follows from a leaf and the nodes beside the k-th one's path."""
        for left, right in self.paths[k]:
            leaf = hashed((left, leaf, right))
        return leaf


OUT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PROOF = "proof array<struct<left: string, right: string>>"


def proved(docs: DataFrame, levels: int = LEVELS, proofs: bool = True, **columns) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, and with `proofs` its proof: what lies left and right of its path, from below.

    proof_sha256 is the hash of the proof's nodes, folded_root the root that the offered row gives with them. columns: see `leaves`.
    """
    hashed_rows = written(leaves(docs, **columns), "leaves")  # a range sort reads its input twice; so texts are read once
    rows, sorted_rows = indexed(hashed_rows, ["doc_id", "leaf"])
    rows = written(rows, "numbered")
    discarded(hashed_rows)
    discarded(sorted_rows)
    nodes, subroots = forest(rows, "leaf", False, levels)
    subroots, sorted_roots = indexed(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("group"), "digest"), ["group"])
    subroots = written(subroots, "subroots")
    discarded(sorted_roots)
    tops, _ = forest(subroots, "digest", True, levels)
    width = ARITY**levels
    groups = subroots.select(F.col("group").alias("tree"), F.col("index").alias("place"), F.col("n").alias("trees"))
    parts = rows.filter(F.col("index") % width == 0).select("tree", F.floor(F.col("index") / width).alias("part"), "n").join(groups, "tree")
    named = nodes.unionAll(tops).select(F.col("tree").alias("node_tree"), "level", "index", "digest")
    lacking = wanted(parts, levels).join(named, ["node_tree", "level", "index"])
    # a partition's own line says where it lies, so that one that lacks nothing is told too
    place = parts.select("tree", "part", F.lit(None).cast("string").alias("node_tree"), F.lit(0).alias("level"), F.col("place").alias("index"), F.col("trees").cast("string").alias("digest"))
    fetched = lacking.select("tree", "part", "node_tree", "level", "index", "digest").unionAll(place)

    def run(mine: pa.Table, told: pa.Table) -> pa.Table:
        mine = mine.sort_by("index")
        own, top, place, trees = {}, {}, 0, 1
        for tree, level, index, digest in zip(*(told.column(c).to_pylist() for c in ("node_tree", "level", "index", "digest")), strict=True):
            if tree is None:
                place, trees = index, int(digest)
            else:
                (top if tree == TOP else own)[level, index] = digest
        digests = mine.column("leaf").to_pylist()
        p = Prover(mine.column("index")[0].as_py(), digests, mine.column("n")[0].as_py(), place, trees, own, top)
        folded = [p.folded(k, leaf) for k, leaf in enumerate(mine.column("offered").to_pylist())]
        same = lambda x: pa.array([x] * len(digests), pa.string())
        told = [hashed(node for sides in path for node in sides) for path in p.paths]
        out = [mine.column("doc_id"), mine.column("leaf"), same(p.subroot), same(p.root), pa.array(told, pa.string()), pa.array(folded, pa.string()), pa.array([f == p.root for f in folded], pa.bool_())]
        if proofs:
            side = pa.struct([("left", pa.string()), ("right", pa.string())])
            out.append(pa.array([[{"left": a, "right": b} for a, b in path] for path in p.paths], pa.list_(side)))
        return pa.table(out, names=schema.names)

    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *StructType.fromDDL(f"{OUT}, {PROOF}" if proofs else OUT).fields])
    dealt = rows.withColumn("part", F.floor(F.col("index") / width))
    return dealt.groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part")).applyInArrow(run, schema)

