"""Merkle manifest of a table as a log of nodes in postorder.

Rows are the leaves of one tree per source, in the order of doc_id; every
three consecutive nodes become their parent (the last run: fewer). The trees'
roots are the leaves of a last tree in the order of source.

A tree is cut into aligned subtrees of ``RADIX ** LEVELS`` leaves. A builder
gets the leaves of one such block and appends nodes in the order in which they
complete; the roots of blocks are the leaves of the next round. Where a node
stands in a log follows from subtree sizes alone: behind m leaves the complete
subtrees named by the digits of m (in base ``RADIX``) have been written, so a
proof's siblings are addressed without an index, and blocks are independent.

NULL and empty fields are told apart (``-`` and ``0:``). Rows without a source
form the first tree; inside a tree rows without a doc_id come first, and rows
of equal doc_id are ordered by their leaf. Repeated rows are leaves of their
own; as they are alike, their order makes no difference. An empty table has no
tree and gives no rows. Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelfield.llm.storage import stored
from voxelfield.operators.joins import voxel_join

RADIX = 3
# Levels of a builder's subtree: blocks of 243 nodes.
LEVELS = 5
BLOCK = RADIX**LEVELS
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# The last tree's name; trees of sources are named "-" (no source) or "s" and the source.
TOP = ""


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while RADIX**levels < n:
        levels += 1
    return levels


def completed(leaves: int) -> int:
    """Nodes written before the leaf that ``leaves`` others precede: the sizes of the subtrees named by the digits."""
    total, size = 0, 1
    while leaves:
        leaves, digit = divmod(leaves, RADIX)
        total += digit * size
        size = size * RADIX + 1
    return total


def position(level: int, index: int, n: int) -> int:
    """Place of a node in the log of a tree of ``n`` leaves."""
    last = min((index + 1) * RADIX**level, n) - 1
    return completed(last) + level


def run(level: int, index: int, n: int) -> range:
    """Indices of the nodes on ``level`` that share a parent with node ``index``."""
    first = index - index % RADIX
    return range(first, min(first + RADIX, -(-n // RADIX**level)))


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def postorder(leaves: list[bytes], levels: int) -> list[bytes]:
    """The log of a tree: leaves, and every node right after its last child."""
    n, log = len(leaves), []
    for i, leaf in enumerate(leaves):
        log.append(leaf)
        index = i
        for level in range(levels):
            if i < n - 1 and (i + 1) % RADIX ** (level + 1):
                break
            siblings = run(level, index, n)
            log.append(parent([log[position(level, j, n)] for j in siblings]))
            index //= RADIX
    return log


def siblings_of(log: list[bytes], index: int, n: int, levels: int) -> list[bytes]:
    """What a leaf's proof takes from a log, from the leaves' level upwards."""
    found = []
    for level in range(levels):
        found += [log[position(level, j, n)] for j in run(level, index, n) if j != index]
        index //= RADIX
    return found


def fold(leaf: bytes, index: int, n: int, siblings: list[bytes]) -> tuple[bytes, int]:
    """The root that a leaf and its proof lead to, and how many siblings were used."""
    used = 0
    for level in range(height(n)):
        nodes = run(level, index, n)
        others = len(nodes) - 1
        own = index - nodes.start
        near = siblings[used : used + others]
        leaf = parent([*near[:own], leaf, *near[own:]])
        used += others
        index //= RADIX
    return leaf, used


def _split(data: bytes) -> list[bytes]:
    return [data[i : i + DIGEST] for i in range(0, len(data), DIGEST)]


# Leaves


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """Digest of a row's fields, some of them replaced."""
    fields = [_field(changed.get(name, F.col(name))) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def leaves(documents: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered): digests of all rows; ``tampered`` where the row is one that tampering touches."""
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    cut = leaf_digest(text=F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    return documents.select(
        tree.alias("tree"), F.col("doc_id").cast("long"), leaf_digest().alias("leaf"), F.when(even, cut).alias("tampered")
    )


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their ``index`` in the tree by ``order`` and the tree's size ``n``, as a written table.

    Rows are dealt by ranges of (tree, order), so a large tree spans many
    tasks; places inside a task are written down, and the tasks' counts per
    tree give the offsets. Rows that agree in all of ``order`` are dealt by a
    number of their own.
    """
    plain = stored(rows.withColumn("__salt", F.monotonically_increasing_id()), f"{name}-rows")
    by = ["tree", *order, "__salt"]
    sorted_rows = plain.repartitionByRange(*by).sortWithinPartitions(*by).drop("__salt")
    at = F.monotonically_increasing_id()
    placed = stored(sorted_rows.withColumn("__at", at), f"{name}-placed").withColumn("__task", F.shiftright("__at", 33))
    spans = placed.groupBy("tree", "__task").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = W.partitionBy("tree").orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select(
        "tree", "__task", "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"),
        F.sum("__rows").over(W.partitionBy("tree")).alias("n"),
    )
    joined = voxel_join(placed, stored(spans, f"{name}-spans"), ["tree", "__task"], row_bytes=128)
    return joined.select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("index"), "n")


# Logs

SEGMENT = "tree string, block long, n long, log binary, root binary"


def _local(index: int, n: int, below: int) -> tuple[int, int, int]:
    """Block of node ``index`` on level ``below``, its nodes there, and the levels its builder adds."""
    nodes = -(-n // RADIX**below)
    block = index // BLOCK
    return block, min(BLOCK, nodes - block * BLOCK), min(LEVELS, height(nodes))


def append_logs(nodes: DataFrame, below: int) -> DataFrame:
    """One segment per block of the nodes (tree, index, n, leaf) on level ``below``: its nodes in completion order, its root."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        n, first = table.column("n")[0].as_py(), table.column("index")[0].as_py()
        block, _, levels = _local(first, n, below)
        log = postorder(table.column("leaf").to_pylist(), levels)
        return pa.table({
            "tree": table.column("tree").slice(0, 1), "block": pa.array([block], pa.int64()), "n": pa.array([n], pa.int64()),
            "log": pa.array([b"".join(log)], pa.binary()), "root": pa.array([log[-1]], pa.binary()),
        })

    rows = nodes.select("tree", "index", "n", "leaf", F.expr(f"index div {BLOCK}").alias("__block"))
    return rows.groupBy("tree", "__block").applyInArrow(build, SEGMENT)


class Forest:
    """Logs of many trees, by rounds of aligned blocks, and the proofs taken from them."""

    def __init__(self, nodes: DataFrame, name: str):
        self.nodes, self.rounds = nodes, []
        largest = nodes.agg(F.max("n")).head()[0] or 0
        while True:
            segments = stored(append_logs(nodes, LEVELS * len(self.rounds)), f"{name}-log")
            self.rounds.append(segments)
            if RADIX ** (LEVELS * len(self.rounds)) >= largest:
                break
            nodes = segments.select("tree", F.col("block").alias("index"), "n", F.col("root").alias("leaf"))

    def roots(self) -> DataFrame:
        """(tree, n, root): trees whose blocks have met."""
        return self.rounds[-1].select("tree", "n", "root")

    def log(self) -> DataFrame:
        """(tree, level, index, position, digest) of all nodes; a block's root is written by the round that completes it."""
        parts = [self._opened(segments, LEVELS * i) for i, segments in enumerate(self.rounds)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    @staticmethod
    def _opened(segments: DataFrame, below: int) -> DataFrame:
        def run_batches(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    block, n, log = row["block"], row["n"], _split(row["log"])
                    _, here, levels = _local(block * BLOCK, n, below)
                    out = []
                    for level in range(0 if not below else 1, levels + 1):
                        for j in range(-(-here // RADIX**level)):
                            index = block * RADIX ** (LEVELS - level) + j
                            out.append((row["tree"], below + level, index, position(below + level, index, n), log[position(level, j, here)]))
                    if out:
                        names = ["tree", "level", "index", "position", "digest"]
                        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        return segments.mapInArrow(run_batches, "tree string, level int, index long, position long, digest binary")

    def block_paths(self, tops: DataFrame) -> DataFrame:
        """The segments of the first round with ``above``, the siblings from a block's root upwards.

        ``tops`` has one row per tree: its ``above`` and further columns, which
        all travel down. Every round hands each block's siblings to the blocks
        below it.
        """
        carried = [c for c in tops.columns if c not in ("tree", "above")]
        paths = tops.withColumn("block", F.lit(0).cast("long"))
        for i in reversed(range(1, len(self.rounds))):
            joined = self.rounds[i].join(paths, ["tree", "block"])
            paths = stored(self._handed_down(joined, LEVELS * i, carried), "paths")
        return self.rounds[0].join(paths, ["tree", "block"])

    @staticmethod
    def _handed_down(joined: DataFrame, below: int, carried: list[str]) -> DataFrame:
        kinds = dict(joined.dtypes)
        schema = "tree string, block long, above binary" + "".join(f", {c} {kinds[c]}" for c in carried)

        def run_batches(batches):
            for batch in batches:
                for i, row in enumerate(batch.select(["tree", "block", "n", "log", "above"]).to_pylist()):
                    log = _split(row["log"])
                    _, here, levels = _local(row["block"] * BLOCK, row["n"], below)
                    above = [b"".join(siblings_of(log, j, here, levels)) + row["above"] for j in range(here)]
                    same = pa.array([i] * here, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("tree").take(same), pa.array([row["block"] * BLOCK + j for j in range(here)], pa.int64()),
                            pa.array(above, pa.binary()), *(batch.column(c).take(same) for c in carried),
                        ],
                        names=["tree", "block", "above", *carried],
                    )

        return joined.select("tree", "block", "n", "log", "above", *carried).mapInArrow(run_batches, schema)


# Manifest

PROOF = (
    "doc_id long, source_index long, source_size long, leaf string, subroot string, root string, siblings binary, "
    "proof_sha256 string, folded_root string, verified boolean"
)


def manifest(documents: DataFrame) -> DataFrame:
    """One row per document: leaf, roots, its proof's siblings and digest, and the check of a tampered copy.

    ``siblings`` holds 32 bytes each, level by level from the leaf's run to the
    last tree's. ``folded_root`` comes from the tampered leaf, where tampering
    touches the row, else from its own, by the proof alone.
    """
    rows = numbered(leaves(documents), ["doc_id", "leaf"], "leaves")
    rows = stored(rows, "leaves")
    forest = Forest(rows, "tree")
    subroots = forest.roots().select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf"))
    tops = Forest(stored(numbered(subroots, ["name"], "tops"), "tops"), "top")
    root = tops.roots().select("tree", F.col("root").alias("top_root"), F.lit(b"").alias("above"))
    top_rows = _top_proofs(tops, tops.block_paths(root))
    blocks = forest.block_paths(top_rows)
    return _leaf_proofs(rows, blocks)


def _top_proofs(tops: Forest, blocks: DataFrame) -> DataFrame:
    """Per source's tree the siblings of its root in the last tree, its place there, and both roots."""

    def work(key: tuple, rows: pa.Table, segment: pa.Table) -> pa.Table:
        rows = rows.sort_by("index")
        block = segment.to_pylist()[0]
        log, first = _split(block["log"]), block["block"] * BLOCK
        _, here, levels = _local(first, block["n"], 0)
        above = [b"".join(siblings_of(log, i - first, here, levels)) + block["above"] for i in rows.column("index").to_pylist()]
        return pa.table({
            "tree": rows.column("name"), "above": pa.array(above, pa.binary()), "subroot": rows.column("leaf"),
            "top_index": rows.column("index"), "top_n": rows.column("n"),
            "top_root": pa.array([block["top_root"]] * rows.num_rows, pa.binary()),
        })

    schema = "tree string, above binary, subroot binary, top_index long, top_n long, top_root binary"
    rows = tops.nodes.withColumn("block", F.expr(f"index div {BLOCK}"))
    return stored(rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(work, schema), "top-proofs")


def _leaf_proofs(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    def work(key: tuple, table: pa.Table, segment: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        block = segment.to_pylist()[0]
        log, first, n = _split(block["log"]), block["block"] * BLOCK, block["n"]
        _, here, levels = _local(first, n, 0)
        above, root = _split(block["above"]), block["top_root"]
        proofs, folded = [], []
        for i, leaf, tampered in zip(*(table.column(c).to_pylist() for c in ("index", "leaf", "tampered"))):
            siblings = siblings_of(log, i - first, here, levels) + above
            top, used = fold(leaf if tampered is None else tampered, i, n, siblings)
            proofs.append(siblings)
            folded.append(fold(top, block["top_index"], block["top_n"], siblings[used:])[0])
        hexes = lambda values: pa.array([v.hex() for v in values], pa.string())
        size = table.num_rows
        return pa.table({
            "doc_id": table.column("doc_id"), "source_index": table.column("index"), "source_size": table.column("n"),
            "leaf": hexes(table.column("leaf").to_pylist()), "subroot": hexes([block["subroot"]] * size), "root": hexes([root] * size),
            "siblings": pa.array([b"".join(p) for p in proofs], pa.binary()),
            "proof_sha256": hexes(parent(p) for p in proofs), "folded_root": hexes(folded),
            "verified": pa.array([f == root for f in folded], pa.bool_()),
        })

    keyed = rows.withColumn("block", F.expr(f"index div {BLOCK}"))
    return keyed.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(work, PROOF)
