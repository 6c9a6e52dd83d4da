"""Mixing sources to target weights.

The words of a source are packed into blocks of ``BLOCK_WORDS``, in an order of
documents that a hash of doc_id gives. Output shards draw multinomial counts
of slots per source; a slot's number within its source goes through a
pseudorandom permutation of the block numbers, so every block is taken equally
often, give or take one. Blocks join slots by (source, block).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelfield.llm.storage import stored
from voxelfield.llm.text import map_slices, slices, words

BLOCK_WORDS = 64
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2.0
SHARD_SLOTS = 4096
# Shards drawn by one task; a group meets its part of the slots exactly.
GROUP_SHARDS = 64
# Ranges of the packing order: more documents make more ranges, not larger ones.
RANGE_ROWS = 2_000
# The mix is configured per source, so the sources are a short list.
MOST_SOURCES = 100_000
SEED = 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sizes(rows: DataFrame) -> DataFrame:
    """(row, doc_id, source, size): words per text of ``rows`` (row, doc_id, source, text)."""

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        _, offsets = words(part.column("text"), lower=False)
        return pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in ("row", "doc_id", "source")), pa.array(np.diff(offsets), pa.int64())],
            names=["row", "doc_id", "source", "size"],
        )

    columns = rows.select("row", F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    return map_slices(columns, handle, "row long, doc_id long, source string, size long")


def targets(totals: np.ndarray, weights: np.ndarray, share: float = SHARE, most: float = MOST_REPEATS) -> np.ndarray:
    """Targets in proportion to ``weights``, none above ``most`` times its source's size.

    What a full source cannot take is shared again among the others by
    weight, until none is above.
    """
    out, caps = np.zeros(len(totals)), most * totals
    left, free = share * totals.sum(), totals > 0
    while free.any():
        offer = left * weights / weights[free].sum()
        over = free & (offer > caps)
        if not over.any():
            out[free] = offer[free]
            break
        out[over] = caps[over]
        left -= caps[over].sum()
        free &= ~over
    return out


def source_table(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> list[dict]:
    """Sources in code-point order, NULL last: size, target, blocks, slots. Bounded by ``MOST_SOURCES``."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    totals = np.array([r["size"] for r in rows], dtype=np.float64)
    weight = np.array([weights[i % len(weights)] for i in range(len(rows))], dtype=np.float64)
    target = targets(totals, weight, share)
    table = []
    for i, row in enumerate(rows):
        blocks = -(-int(totals[i]) // BLOCK_WORDS)
        # A block holds size / blocks words on average.
        slots = min(round(target[i] / totals[i] * blocks), int(MOST_REPEATS) * blocks) if blocks else 0
        table.append({"source": row["source"], "no": i, "size": int(totals[i]), "target": float(target[i]), "blocks": blocks, "slots": slots})
    return table


def sources(spark: SparkSession, table: list[dict]) -> DataFrame:
    """The source table as rows; it is broadcast, its size is bounded by ``MOST_SOURCES``."""
    rows = [(r["source"], r["no"], r["size"], r["target"]) for r in table]
    return F.broadcast(spark.createDataFrame(rows, "name string, no int, source_size long, target double"))


def packed(sized: DataFrame, table: list[dict]) -> DataFrame:
    """(row, doc_id, no, size, source_size, target, start): where rows start in their source's stream of words.

    Rows are ordered by a hash of doc_id; the hash's range is cut into equal
    parts, running sums are taken within parts, and a part starts where the
    parts before it end. No source is sorted as a whole.
    """
    names = sources(sized.sparkSession, table)
    order = F.xxhash64("doc_id", F.lit(SEED))
    parts = max(1, -(-sized.count() // RANGE_ROWS))
    part = F.floor((F.col("order").cast("double") / float(2**64) + 0.5) * parts).cast("int")
    ordered = sized.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("source", "name").withColumn("order", order)
    ordered = ordered.withColumn("part", F.least(part, F.lit(parts - 1)))
    before = W.partitionBy("no").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = ordered.groupBy("no", "part").agg(F.sum("size").alias("total")).select(
        "no", "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")
    )
    inside = W.partitionBy("no", "part").orderBy("order", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    within = ordered.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return within.join(bases, ["no", "part"]).withColumn("start", F.col("base") + F.col("within")).drop(
        "part", "order", "base", "within"
    )


def permuted(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """Pseudorandom permutation of 0 .. n - 1 (Feistel rounds; values outside walk on)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(rounds):
            f = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) % 2**64)) * np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(29)
            f = (f * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def draw_shards(slots: np.ndarray, shards: int, seed: Sequence[int]) -> np.ndarray:
    """Slots per shard and source: multinomial draws by what is left of each source.

    A shard's counts are a multinomial draw whose probabilities are the shares
    of the slots still to be placed; no source gives more than it has left and
    the last shard takes the rest, so the totals are ``slots`` exactly.
    """
    rng = np.random.default_rng(list(seed))
    left = slots.astype(np.int64).copy()
    out = np.zeros((shards, len(slots)), dtype=np.int64)
    for shard in range(shards):
        want = -(-int(left.sum()) // (shards - shard))
        while want:
            draw = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[shard] += draw
            left -= draw
            want -= int(draw.sum())
    return out


def drawn_slots(spark: SparkSession, table: list[dict]) -> DataFrame:
    """(shard, no, block): every slot of the mix and the block it takes.

    Groups of shards get equal parts of each source's slots and draw their
    shards independently; a group is one row of input and one bounded task.
    """
    live = [r for r in table if r["slots"]]
    slots = np.array([r["slots"] for r in live], dtype=np.int64)
    if not len(live):
        return spark.createDataFrame([], "shard long, no int, block long")
    shards = max(1, -(-int(slots.sum()) // SHARD_SLOTS))
    groups = -(-shards // GROUP_SHARDS)
    numbers, blocks = [r["no"] for r in live], [r["blocks"] for r in live]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column("group").to_pylist():
                first = slots * group // groups
                own = slots * (group + 1) // groups - first
                count = min(GROUP_SHARDS, shards - group * GROUP_SHARDS)
                drawn = draw_shards(own, count, (SEED, group))
                begin = first + np.cumsum(drawn, axis=0) - drawn
                for shard in range(count):
                    no = np.repeat(np.arange(len(live)), drawn[shard])
                    slot = np.concatenate([np.arange(b, b + d) for b, d in zip(begin[shard], drawn[shard])])
                    block = np.empty(len(slot), dtype=np.int64)
                    for s in range(len(live)):
                        mine = no == s
                        block[mine] = permuted(slot[mine] % blocks[s], blocks[s], SEED * 1_000_003 + numbers[s])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(slot), group * GROUP_SHARDS + shard), pa.int64()),
                            pa.array(np.array(numbers, dtype=np.int32)[no], pa.int32()),
                            pa.array(block, pa.int64()),
                        ],
                        names=["shard", "no", "block"],
                    )

    ids = spark.range(0, groups, 1, min(groups, 1000)).select(F.col("id").alias("group"))
    return ids.mapInArrow(run, "shard long, no int, block long")


def pieces(streams: DataFrame) -> DataFrame:
    """The words [at, at + words) that a row has in each block it reaches."""
    first, last = F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    cut = streams.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("block") * BLOCK_WORDS)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    return cut.withColumn("at", begin - F.col("start")).withColumn("words", end - begin)


def takings(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame | None:
    """Pieces of all rows with how often the mix takes their block; None without any row.

    ``sized`` is a stored table as ``sizes`` gives it. Rows without words
    have one piece of 0 words.
    """
    spark = sized.sparkSession
    table = source_table(sized, weights, share)
    if not table:
        return None
    streams = packed(sized.where("size > 0"), table)
    times = drawn_slots(spark, table).groupBy("no", "block").agg(F.count("*").alias("times"))
    columns = ["row", "doc_id", "size", "source_size", "target", "at", "words", "times"]
    # The planner takes the slots for a small table, as they come from a few groups; they grow with the corpus.
    taken = pieces(streams).join(times.hint("merge"), ["no", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    blank = sized.where("size = 0").join(sources(spark, table), F.col("source").eqNullSafe(F.col("name")))
    nothing = blank.withColumns({c: F.lit(0).cast("long") for c in ("at", "words", "times")})
    return taken.select(*columns).union(nothing.select(*columns))


def numbered(documents: DataFrame) -> DataFrame:
    return documents.withColumn("row", F.monotonically_increasing_id())


def mix_sources(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """What the mix takes of each row of ``documents`` (doc_id, text, source; further columns are ignored).

    Returns doc_id, size, source_size, target (its source's) and taken (words
    of the row in the mix, repeats counted). A NULL source is a source of its
    own, last in order. Rows without words, NULL texts included, take
    nothing; a source without words has target 0. Rows that repeat a doc_id
    are packed one by one. Empty input, empty result.
    """
    sized = stored(sizes(numbered(documents.select("doc_id", "source", "text"))), "sizes")
    rows = takings(sized, weights, share)
    if rows is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, size long, source_size long, target double, taken long")
    totals = rows.groupBy("row").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "size", "source_size", "target")],
        F.sum(F.col("words") * F.col("times")).alias("taken"),
    )
    return totals.drop("row")


def mixed_documents(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The mix as documents, in the columns of ``documents`` (doc_id, text, source, n_chars and others).

    A row appears once for each repeat it has a share in: repeat k keeps the
    words whose block is taken at least k times, with the white space that
    follows them. A row taken whole keeps its text as it is; a row of which
    nothing is taken is not in the mix, and a row without words has nothing to
    take. n_chars, where there is such a column, is counted anew.
    """
    columns = documents.columns
    # Columns travel as one, so that no name of theirs, in upper or lower case, can clash.
    held = stored(numbered(documents.select(F.struct(*columns).alias("doc"))), "mixed")
    rows = takings(stored(sizes(held.select("row", "doc.doc_id", "doc.source", "doc.text")), "sizes"), weights, share)
    if rows is None:
        return documents
    cuts = rows.where("times > 0").groupBy("row").agg(F.collect_list(F.struct("at", "words", "times")).alias("cuts"))
    whole = held.join(cuts, "row").select("doc", F.col("doc.text").alias("text"), "cuts")
    place = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                source_rows, texts = [], []
                for i, (text, found) in enumerate(zip(part.column("text").to_pylist(), part.column("cuts").to_pylist())):
                    for copy in copies(text, [(c["at"], c["words"], c["times"]) for c in found]):
                        source_rows.append(i)
                        texts.append(copy)
                taken = part.column("doc").take(pa.array(source_rows, pa.int64())).flatten()
                arrays = [pa.array(texts, pa.string()) if i == place else taken[i] for i in range(len(columns))]
                if "n_chars" in columns:
                    at = columns.index("n_chars")
                    arrays[at] = pa.array([len(t) for t in texts], pa.int64()).cast(arrays[at].type)
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return whole.mapInArrow(run, documents.schema)


def copies(text: str, cuts: list[tuple[int, int, int]]) -> list[str]:
    """Text of each repeat, from (first word, words, times) of its pieces."""
    starts = [m.start() for m in WORD.finditer(text)]
    ends = [0, *starts[1:], len(text)]  # what stands before the first word stays with it
    out = []
    for repeat in range(1, max(t for _, _, t in cuts) + 1):
        parts = sorted((at, n) for at, n, times in cuts if times >= repeat)
        out.append("".join(text[ends[at] : ends[at + n]] for at, n in parts))
    return out
