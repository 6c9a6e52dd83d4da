"""SpotSigs document fingerprints.

Every occurrence of an anchor, a common word, starts a spot: the anchor with
the chain of the next content words, ``CHAIN`` of them ``SPACING`` apart. In a
stretch of more than ``STRETCH`` content words without an anchor, and in a text
without any, every content word starts a spot, so that no language, table or
code is read by its first words alone. A text's fingerprint is the set of its
spots. Fingerprints are partitioned by
set length so that sets too different in length to be similar never meet, and
compared by Jaccard similarity with pruning by length and by what is still to
come.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelfield.llm.components import connected_components
from voxelfield.llm.storage import stored
from voxelfield.llm.text import chain_hash, coded, hashes, slices, words
from voxelfield.operators.joins import known_bytes
from voxelfield.operators.ranking import range_cuts, with_range

# Common words of English, German, French and Spanish.
ANCHORS = tuple(
    "the of and to is that for was der die und den von ist que les des est pour dans el los del por una".split()
)
CHAIN, SPACING = 2, 1
# Longest run of content words between chains without further spots: two words, three at the end, go unread.
STRETCH = 4
# Hex digits of a spot in a fingerprint.
DIGITS = 8
MARKS = ".,;:!?\"'()[]|*&%$#…"
BLOCK_BYTES = 16 * 1024 * 1024
FEWEST_BLOCKS, MOST_BLOCKS = 64, 1 << 20


def spot_sets(texts: pa.Array, anchors: Sequence[str] = ANCHORS, chain: int = CHAIN, spacing: int = SPACING) -> list[np.ndarray]:
    """Sorted distinct spots (32 bits) per text.

    The start of a text counts as an anchor, so every text with a word has a
    spot, and so do the content words of long stretches without one. Chains that the end of the text cuts off are left out, except at the
    start. A text without a word (only marks or white space) has its whole
    content as its one spot, the empty text too.
    """
    flat, offsets = words(pc.utf8_lower(pc.fill_null(texts, "")), lower=False)
    flat = pc.utf8_trim(flat, characters=MARKS)
    codes, distinct = coded(flat)
    hashed = hashes(distinct)
    common = np.asarray(pc.is_in(distinct, pa.array(list(anchors))), dtype=bool)
    blank = np.asarray(pc.equal(distinct, ""), dtype=bool)
    hashed, common, blank = (x[codes] if len(codes) else x[:0] for x in (hashed, common, blank))
    rest = texts.to_pylist()
    out = []
    for i, (start, stop) in enumerate(zip(offsets[:-1], offsets[1:])):
        h, anchor, empty = hashed[start:stop], common[start:stop], blank[start:stop]
        content = h[~anchor & ~empty]
        if not len(content):
            whole = int.from_bytes(hashlib.sha256((rest[i] or "").encode("utf-8", "surrogatepass")).digest()[:4], "big")
            out.append(np.array([whole], dtype=np.uint32))
            continue
        # Position in the content words that follows each anchor.
        after = np.cumsum(~anchor & ~empty)[anchor]
        last = len(content) - (chain - 1) * spacing
        after, heads = after[after < last], h[anchor][after < last]
        spots = chain_hash([heads, *(content[after + k * spacing] for k in range(chain))], chain)
        # Stretches between chains; words of long ones start chains as anchors do.
        bounds = np.concatenate([[0], after, [max(0, last)]])
        runs = np.diff(bounds)
        bare = np.flatnonzero(np.repeat(runs > (STRETCH if len(after) else 0), runs)[: max(0, last - 1)])
        filled = chain_hash([content[bare], *(content[bare + 1 + k * spacing] for k in range(chain))], chain)
        first = content[: (chain - 1) * spacing + 1 : spacing]
        opening = chain_hash([first[k : k + 1] for k in range(len(first))], 32 + len(first))
        out.append(np.unique((np.concatenate([spots, filled, opening]) >> np.uint64(32)).astype(np.uint32)))
    return out


def written(spots: np.ndarray) -> str:
    """A fingerprint as text: its spots in order, ``DIGITS`` hex digits each."""
    return spots.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def length_bounds(least: float, most: int) -> list[int]:
    """Starts of length partitions: sets similar by ``least`` lie in one partition or in neighbours."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(max(bounds[-1] + 1, int(np.ceil(bounds[-1] / least))))
    return bounds


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of sorted sets; 0 as soon as it cannot reach ``least``.

    The ratio of lengths bounds the similarity from above, then, piece by
    piece, what has been matched with all that is still to come.
    """
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < least * len(large):
        return 0.0
    both, n, m = 0, len(small), len(large)
    piece = max(256, n // 4)
    for start in range(0, n, piece):
        part = small[start : start + piece]
        at = np.searchsorted(large, part)
        both += int((large[np.minimum(at, m - 1)] == part).sum())
        best = both + max(0, n - start - piece)
        if best < least * (n + m - best):
            return 0.0
    return both / (n + m - both)


def edited(text: str, following: str) -> str:
    """The last half of a text (code points, rounded down) replaced by as many first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(documents: DataFrame) -> DataFrame:
    """Rows of ``documents`` (doc_id, text) in blocks of descending doc_id, each with the row after its block.

    Blocks are ranges of doc_id. The first row of the next block is delivered
    twice, as that row and, marked ``extra``, as the end of the block before;
    the last block is followed by the first. Rows without a doc_id come last;
    equal doc_ids are in order of their text.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = max(FEWEST_BLOCKS, min(MOST_BLOCKS, known_bytes(documents.select("text")) // BLOCK_BYTES))
    cuts = range_cuts(documents, "doc_id", ranges)
    ranged = with_range(docs, "doc_id", cuts, "block").withColumn(
        "block", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("block"))
    )
    # One row per block: the block and its first doc_id.
    heads = ranged.groupBy("block").agg(F.max("doc_id").alias("head")).collect()
    blocks = sorted((r["block"] for r in heads), reverse=True)
    before = {b: blocks[i - 1] for i, b in enumerate(blocks)}
    head = {r["block"]: r["head"] for r in heads}
    if not blocks:
        return ranged.withColumn("extra", F.lit(False))
    lookup = documents.sparkSession.createDataFrame([(b, head[b], before[b]) for b in blocks], "block int, head long, before int")
    tagged = ranged.join(F.broadcast(lookup), "block")
    copies = F.array(F.struct(F.col("block").alias("to"), F.lit(False).alias("extra")))
    both = F.array(F.struct(F.col("block").alias("to"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("to"), F.lit(True).alias("extra")))
    sent = F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), both).otherwise(copies))
    rows = tagged.select("doc_id", "text", sent.alias("sent"))
    return rows.select("doc_id", "text", F.col("sent.to").alias("block"), F.col("sent.extra").alias("extra"))


def fingerprints_with_next(documents: DataFrame) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and their likeness.

    One row per row of ``documents`` (doc_id, text; further columns are
    ignored): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next. NULL reads as empty. The
    next document is the one of the next smaller doc_id, the first after the
    last; a lone row follows itself.
    """
    rows = in_order(documents)
    rows = rows.repartition("block").sortWithinPartitions(
        "block", "extra", F.col("doc_id").desc_nulls_last(), "text"
    )
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def described(ids: list, texts: list[str], following: list[str], spots: list, next_spots: list) -> pa.RecordBatch:
        changed = [edited(t, f) for t, f in zip(texts, following)]
        changed_spots = spot_sets(pa.array(changed, pa.string()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed], pa.string()),
                pa.array([written(s) for s in spots], pa.string()),
                pa.array([written(s) for s in changed_spots], pa.string()),
                pa.array([pruned_jaccard(a, b) for a, b in zip(spots, changed_spots)], pa.float64()),
                pa.array([pruned_jaccard(a, b) for a, b in zip(spots, next_spots)], pa.float64()),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row met, which still lacks its next one
        for batch in batches:
            for part in slices(batch):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                blocks, extra = part.column("block").to_pylist(), part.column("extra").to_pylist()
                spots = spot_sets(part.column("text"))
                line = list(zip(ids, texts, blocks, extra, spots))
                line = line if held is None else [held, *line]
                # A row has a next one in its block unless it is the block's extra row.
                own = [(x, y) for x, y in zip(line, line[1:]) if not x[3] and x[2] == y[2]]
                if own:
                    yield described(
                        [x[0] for x, _ in own], [x[1] for x, _ in own], [y[1] for _, y in own], [x[4] for x, _ in own], [y[4] for _, y in own]
                    )
                held = line[-1]

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return rows.select("doc_id", "text", "block", "extra").mapInArrow(run, schema)


def similar_classes(fingerprints: DataFrame, least: float = 0.75) -> DataFrame:
    """(doc_id, class_id) of documents linked by fingerprints of similarity ``least`` or more.

    Equal fingerprints are one node. A node belongs to the partition of its
    set length and is also offered to the next one, the only other partition
    where sets similar enough can lie. Within a partition nodes meet through
    an inverted index on the rarest spots: similar sets share one of the
    first ``n - ceil(least * n) + 1`` spots in order of rarity. Pairs are
    then compared by pruned Jaccard similarity.
    """
    nodes = stored(
        fingerprints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")).withColumn("n", (F.length("fingerprint") / DIGITS).cast("int")),
        "spots",
    )
    most = nodes.agg(F.max("n")).head()[0] or 1
    bounds = length_bounds(least, most)
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("n")))
    spots = nodes.select("node", "n", F.explode(F.expr(f"transform(sequence(0, n - 1), i -> substring(fingerprint, i * {DIGITS} + 1, {DIGITS}))")).alias("spot"))
    weights = spots.groupBy("spot").agg(F.count("*").alias("weight"))
    ranked = spots.join(weights, "spot").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("weight", "spot"))).alias("spots"))
    kept = F.col("n") - F.ceil(F.lit(least) * F.col("n")).cast("int") + 1
    prefix = ranked.withColumn("part", part).select("node", "n", "part", F.explode(F.slice("spots", F.lit(1), kept)).alias("s"))
    index = stored(prefix.select("node", "n", "part", F.col("s.spot").alias("spot")), "index")
    left, right = index.alias("l"), index.alias("r")
    pairs = (
        left.join(right, (F.col("l.spot") == F.col("r.spot")) & (F.col("r.part") - F.col("l.part")).isin(0, 1))
        .where((F.col("l.n") >= least * F.col("r.n")) & (F.col("r.n") >= least * F.col("l.n")))
        .where((F.col("l.part") < F.col("r.part")) | (F.col("l.node") < F.col("r.node")))
        .select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
        .distinct()
    )
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("fingerprint").alias(f"{side}_print")), side)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [
                pruned_jaccard(read(x), read(y), least) >= least
                for x, y in zip(batch.column("a_print").to_pylist(), batch.column("b_print").to_pylist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    links = pairs.select("a", "b", "a_print", "b_print").mapInArrow(compare, "a long, b long")
    classes = connected_components(links)
    named = nodes.join(classes, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("class_id"))
    return fingerprints.join(named, "fingerprint").select("doc_id", "class_id")
