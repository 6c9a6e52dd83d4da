"""MinHash near-duplicates with sequential Bayesian verification.

Documents with the same shingle set form one node. A signature of ``BANDS`` x
``ROWS`` minima per node is cut into bands; nodes that share a band are
candidates. A candidate's signatures are compared batch by batch; it is
dropped once the posterior probability (uniform prior) that its similarity
reaches the threshold is below the chosen miss probability. Survivors are
confirmed on the full sets.

Hot groups. Copies collapse into one node before anything is paired. Each
bucket is then compared with one pivot (the pivot differs between classes of
bands), which is linear in the bucket and joins most of a group of near
copies. Only buckets that still hold several components go on; their members
meet in blocks of bounded size, pairs inside one component are skipped, and a
block hands out links that join components, never all its pairs. Every
candidate pair is thus either inside one component already, dropped by the
posterior, or confirmed or refuted on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelfield.llm.components import connected_components
from voxelfield.llm.storage import stored
from voxelfield.llm.text import map_slices, mixed, shingle_sets, slices
from voxelfield.operators.joins import voxel_join

SHINGLE = 5
PERCENT = 75
# 1 - (1 - 0.75 ** 5) ** 51: a pair at the threshold is missed once in a million.
ROWS, BANDS = 5, 51
HASHES = ROWS * BANDS
BATCH = 51
MISS = 1e-7
BLOCK = 512
PIVOT_ORDERS = 4
_FACTORS = (np.array([xxhash.xxh3_64_intdigest(f"row {i}") for i in range(HASHES)], dtype=np.uint64) >> np.uint64(32)).astype(
    np.uint32
) | np.uint32(1)
_PIECE = 2048


def signature(shingles: np.ndarray) -> np.ndarray:
    """``HASHES`` minima of a set of 64-bit shingle hashes; each hash function is a 32-bit multiplication."""
    low = (mixed(shingles) >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(low), _PIECE):
        part = (_FACTORS[:, None] * low[None, start : start + _PIECE]).min(axis=1)
        np.minimum(least, part, out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """One signed 64-bit key per band."""
    rows = least.reshape(BANDS, ROWS)
    return [
        int(np.uint64(xxhash.xxh3_64_intdigest(row.tobytes(), seed=band)).astype(np.int64)) for band, row in enumerate(rows)
    ]


def fewest_matches(percent: int = PERCENT, miss: float = MISS) -> list[tuple[int, int]]:
    """(compared, matches needed) after each batch.

    Signatures are compared by their lowest byte, so a position agrees with
    probability p = s + (1 - s) / 256. With a uniform prior, the posterior
    probability of p >= t after m of n matches is that of at most m successes
    in n + 1 trials of probability t.
    """
    s = percent / 100
    t = s + (1 - s) / 256
    table = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        table.append((n, m))
    return table


def survives(a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Rows of signature bytes ``a`` and ``b`` that no batch rules out."""
    alive = np.arange(len(a))
    matches, start = np.zeros(len(a), dtype=np.int64), 0
    for stop, least in needed:
        matches[alive] += (a[alive, start:stop] == b[alive, start:stop]).sum(axis=1)
        alive = alive[matches[alive] >= least]
        start = stop
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, on sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _set_key(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def sketches(documents: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, carry, n_shingles, node, bands): node is a 128-bit key of the shingle set, NULL for none."""
    columns = ["doc_id", *carry]
    rows = documents.select(*columns, F.col("text").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema)

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column("__text"), SHINGLE)
        return pa.RecordBatch.from_arrays(
            [
                *(part.column(c) for c in columns),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_set_key(s) for s in sets], pa.binary()),
                pa.array([band_keys(signature(s)) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ],
            names=[*columns, "n_shingles", "node", "bands"],
        )

    return map_slices(rows, handle, f"{schema}, n_shingles long, node binary, bands array<long>", "__text")


def bodies(documents: DataFrame) -> DataFrame:
    """(node, doc_id, signature, shingles) of documents that have candidates."""

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column("text"), SHINGLE)
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array([_set_key(s) for s in sets], pa.binary()),
                pa.array([signature(s).astype(np.uint8).tobytes() for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
            ],
            names=["doc_id", "node", "signature", "shingles"],
        )

    schema = "doc_id long, node binary, signature binary, shingles binary"
    return map_slices(documents.select(F.col("doc_id").cast("long"), "text"), handle, schema)


def candidates(rows: DataFrame) -> DataFrame:
    """(band, node) for every band key that at least two different nodes share."""
    banded = rows.where("node is not null").select(F.explode("bands").alias("band"), "node")
    mark = F.xxhash64("node")
    ends = banded.groupBy("band").agg(F.min(mark).alias("least"), F.max(mark).alias("most"))
    shared = stored(ends.where("least <> most").select("band"), "bands")
    return voxel_join(banded, shared, ["band"], row_bytes=64).distinct()


def pivot_pairs(members: DataFrame) -> DataFrame:
    """Each bucket's members with its pivot, every pair once."""
    order = F.xxhash64("node", F.pmod("band", F.lit(PIVOT_ORDERS)))
    pivots = members.groupBy("band").agg(F.min_by("node", order).alias("pivot"))
    pairs = members.join(pivots, "band").where("node <> pivot")
    return pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), HASHES)


def _with(pairs: DataFrame, body: DataFrame, column: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(body.select(F.col("node").alias(side), F.col(column).alias(f"{side}_{column}")), side)
    return pairs


def confirmed(pairs: DataFrame, body: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """Pairs (a, b) that pass the sequential test and then the exact test on full sets."""
    needed = fewest_matches(percent, miss)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = survives(_matrix(batch.column("a_signature")), _matrix(batch.column("b_signature")), needed)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "a_shingles"):
                keep = [
                    similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                    for x, y in zip(part.column("a_shingles").to_pylist(), part.column("b_shingles").to_pylist())
                ]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    alive = _with(pairs, body, "signature").select("a", "b", "a_signature", "b_signature").mapInArrow(prune, "a binary, b binary")
    wide = _with(alive, body, "shingles").select("a", "b", "a_shingles", "b_shingles")
    return wide.mapInArrow(verify, "a binary, b binary")


class _Forest:
    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x


def block_links(block: pa.Table, needed: list[tuple[int, int]], percent: int) -> list[tuple[int, int]]:
    """Rows of a pair of blocks to link: enough links to join all components that touch.

    Pairs of one component are skipped; of the others, those that survive the
    signature batches are checked on full sets until their components meet.
    """
    sides = np.asarray(block.column("side").combine_chunks())
    rows_a, rows_b = np.flatnonzero(sides <= 0), np.flatnonzero(sides >= 0)
    labels = block.column("component").combine_chunks().dictionary_encode()
    label = np.asarray((labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels).indices)
    signatures = _matrix(block.column("signature").combine_chunks())
    sets = [np.frombuffer(x, np.uint64) for x in block.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    forest, links = _Forest(int(label.max()) + 1), []
    for i in rows_a:
        others = rows_b[(rows_b > i) | (sides[rows_b] > 0)] if sides[i] == 0 else rows_b
        roots = np.array([forest.find(x) for x in range(len(forest.parent))])[label]
        fits = 100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])
        others = others[(roots[others] != roots[i]) & fits]
        if not len(others):
            continue
        keep = survives(np.broadcast_to(signatures[i], (len(others), HASHES)), signatures[others], needed)
        for j in others[keep]:
            x, y = forest.find(int(label[i])), forest.find(int(label[j]))
            if x != y and similar(sets[i], sets[j], percent):
                forest.parent[x] = y
                links.append((int(i), int(j)))
    return links


def crossing_links(
    members: DataFrame, components: DataFrame, body: DataFrame, percent: int = PERCENT, miss: float = MISS
) -> DataFrame:
    """Links between components whose members share a bucket."""
    needed = fewest_matches(percent, miss)
    labelled = members.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_bands = labelled.groupBy("band").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    ).where("least <> most").select("band", "blocks")
    spread = (
        labelled.join(open_bands, "band")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "band", "node", "component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
            F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1).alias("side"),
        )
    )
    rows = spread.join(body.select("node", "signature", "shingles"), "node")

    def link(block: pa.Table) -> pa.Table:
        nodes = block.column("node").to_pylist()
        found = block_links(block, needed, percent)
        return pa.table(
            {"a": pa.array([nodes[i] for i, _ in found], pa.binary()), "b": pa.array([nodes[j] for _, j in found], pa.binary())}
        )

    return rows.groupBy("band", "x", "y").applyInArrow(link, "a binary, b binary").distinct()


def near_duplicates(
    documents: DataFrame, percent: int = PERCENT, miss: float = MISS, carry: Sequence[str] = (), class_key: str | None = None
) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text and ``carry``; further columns are ignored).

    Returns doc_id, n_shingles, component_id (least doc_id of its class of
    linked documents) and kept (doc_id = component_id). Two documents are
    linked when 100 * intersection >= ``percent`` * union of their sets of
    five-word shingles (words split at ASCII white space, A-Z lowered; shorter
    texts are one shingle). NULL, empty and blank texts have no shingles, are
    linked with nothing and kept. Rows without a doc_id get the least doc_id
    of their class, if any has one; a class without any stays NULL and its
    rows are kept. ``class_key`` names a further column with a key of the class
    that needs no doc_id (its least node; NULL without shingles). Rows that repeat a doc_id with equal texts share a class
    and are kept or dropped alike. Empty input gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    rows = stored(sketches(docs, carry), "sketches")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    nodes = stored(nodes, "nodes")
    members = stored(candidates(rows), "members")

    paired = stored(members.select("node").distinct(), "paired")
    wanted = stored(nodes.join(paired, "node", "left_semi").select("doc_id").distinct(), "wanted")
    docs = docs.select("doc_id", "text")
    chosen = voxel_join(docs, wanted, ["doc_id"], "left_semi", row_bytes=32).union(docs.where("doc_id is null"))
    body = stored(bodies(chosen).join(paired, "node", "left_semi").dropDuplicates(["node"]), "bodies")

    first = stored(confirmed(pivot_pairs(members), body, percent, miss), "links")
    parts = stored(connected_components(first), "components")
    second = crossing_links(members, parts, body, percent, miss)
    links = stored(first.union(second), "links")
    parts = connected_components(links)

    label = nodes.join(parts, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = label.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = label.join(least, "component").select("node", "component_id", "component")
    out = rows.drop("bands").join(classes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    key = [F.col("component").alias(class_key)] if class_key else []
    return out.select("doc_id", *carry, "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *key)
