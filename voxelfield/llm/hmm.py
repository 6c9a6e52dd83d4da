"""Hidden Markov language model.

Tokens are words (ASCII white space, A-Z lowered) and one end per text. Each of
``STATES`` latent states emits one of the ``EMITTED`` most frequent words, the
end, or the class of all other words; a word of that class has the same
probability in every state, by its corpus count. Training aggregates
Baum-Welch counts of all partitions; scoring runs the scaled forward recursion
over whole texts, so a score is the exact log-probability of the sequence.

Word counts are a distributed table. Only its ``TABLE_WORDS`` most frequent
short words are sent to tasks; all others meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelfield.llm.storage import stored
from voxelfield.llm.text import coded, map_slices, words

STATES = 8
EMITTED = 1 << 15
# Words sent to every task, and the longest of them: at most 16 MB.
TABLE_WORDS = 1 << 18
TABLE_BYTES = 48
ADDED = 0.1
# Strength of the unigram prior of emissions, and of uniform transitions.
PRIOR_WORDS, PRIOR_MOVES = 50.0, 1.0
# Rounds over all training texts: the first in any case, the others while a token gains so much log-likelihood.
WARM_ROUNDS, ROUNDS, GAIN = 4, 9, 2e-3
# Tokens trained on together, whose states are all held; longer texts are trained on alone, by windows of so many.
TRAIN_HELD = 1 << 20
# Rows of one single-precision sum of transitions.
PRODUCT_ROWS = 1 << 12
# Tokens scored together; longer texts are scored alone.
SCORE_TOKENS = 4_000_000


def held_out() -> Column:
    """Rows whose crc32 of doc_id as text is divisible by 10; a NULL doc_id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, c): counts over all texts; each task hands out one row per word and slice."""

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        flat, _ = words(part.column("text"))
        found = flat.value_counts()
        return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "c"])

    counts = map_slices(documents.select("text"), handle, "word string, c long")
    return counts.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Vocabulary:
    """The most frequent words with their counts, and totals over all."""

    table: pa.Array
    counts: np.ndarray
    tokens: int
    distinct: int
    texts: int

    @property
    def emitted(self) -> int:
        return min(EMITTED, len(self.counts))

    @property
    def other(self) -> int:
        """Class of words that no state emits by themselves."""
        return self.emitted

    @property
    def end(self) -> int:
        return self.emitted + 1

    @property
    def total(self) -> float:
        return self.tokens + ADDED * (self.distinct + 1)

    def prior(self) -> np.ndarray:
        """Smoothed unigram probability of each class; the class of others holds the unseen word too."""
        own = (self.counts[: self.emitted] + ADDED) / self.total
        # Without any training text the end shares the mass of the unseen word.
        end = (self.texts + ADDED) / self.total if self.texts else ADDED / self.total / 2
        return np.concatenate([own, [max(1 - own.sum() - end, 1e-300), max(end, 1e-300)]])

    @property
    def other_mass(self) -> float:
        """Smoothed count of all words of the class of others, unseen word included."""
        return self.prior()[self.other] * self.total


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    totals = counts.agg(F.sum("c").alias("tokens"), F.count("*").alias("distinct")).head()
    short = counts.where(F.octet_length("word") <= TABLE_BYTES)
    top = short.orderBy(F.col("c").desc(), "word").limit(TABLE_WORDS).toArrow()
    return Vocabulary(
        top.column("word").combine_chunks().cast(pa.string()), np.asarray(top.column("c").combine_chunks(), dtype=np.int64),
        int(totals["tokens"] or 0) + texts, int(totals["distinct"]) + (texts > 0), texts,
    )


def encoded(documents: DataFrame, known: Vocabulary) -> DataFrame:
    """``documents`` (row, doc_id, held_out, text) as ranks in the table, -1 for other words; those with their numbers."""
    sent = documents.sparkSession.sparkContext.broadcast(known.table)
    pairs = pa.struct([("word", pa.string()), ("n", pa.int64())])

    def handle(part: pa.RecordBatch) -> pa.RecordBatch:
        flat, offsets = words(part.column("text"))
        codes, distinct = coded(flat)
        rank = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=sent.value), -1), dtype=np.int32)
        ranks = rank[codes] if len(codes) else np.zeros(0, dtype=np.int32)
        # Words without a rank, once per text.
        at = np.flatnonzero(ranks < 0)
        text_of = np.searchsorted(offsets, at, side="right") - 1
        keys, numbers = np.unique(text_of * max(1, len(distinct)) + codes[at], return_counts=True)
        owner, code = np.divmod(keys, max(1, len(distinct)))
        starts = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
        entries = pa.StructArray.from_arrays([distinct.take(pa.array(code)), pa.array(numbers, pa.int64())], fields=list(pairs))
        return pa.RecordBatch.from_arrays(
            [
                *(part.column(c) for c in ("row", "doc_id", "held_out")),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ranks)),
                pa.ListArray.from_arrays(pa.array(starts), entries),
            ],
            names=["row", "doc_id", "held_out", "ranks", "others"],
        )

    schema = "row long, doc_id long, held_out boolean, ranks array<int>, others array<struct<word:string,n:long>>"
    return map_slices(documents.select("row", "doc_id", "held_out", "text"), handle, schema)


@dataclass(frozen=True)
class Model:
    """Start, transition (from, to) and emission (class, state) probabilities; of fixed size."""

    start: np.ndarray
    moves: np.ndarray
    emissions: np.ndarray


def first_model(known: Vocabulary, seed: int = 7) -> Model:
    prior, rng = known.prior(), np.random.default_rng(seed)
    emissions = prior[:, None] * rng.uniform(0.5, 1.5, (len(prior), STATES))
    moves = np.full((STATES, STATES), 0.05 / max(1, STATES - 1))
    np.fill_diagonal(moves, 0.95)
    return Model(np.full(STATES, 1 / STATES), moves, emissions / emissions.sum(axis=0))


def _classes(ranks: np.ndarray, known: Vocabulary) -> np.ndarray:
    return np.where((ranks < 0) | (ranks >= known.emitted), known.other, ranks)


def _sequences(column: pa.Array, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts in one array, each text followed by an end; and where texts start."""
    lengths = np.asarray(pc.list_value_length(column), dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(starts[-1], known.end, dtype=np.int64)
    inside = np.ones(starts[-1], dtype=bool)
    inside[starts[1:] - 1] = False
    out[inside] = _classes(np.asarray(pc.list_flatten(column), dtype=np.int64), known)
    return out, starts


def forward(classes: np.ndarray, starts: np.ndarray, model: Model) -> np.ndarray:
    """Log10 probability of each sequence, by the scaled forward recursion over all of it."""
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = starts[:-1][order], lengths[order]
    out = np.zeros(len(order))
    state = np.broadcast_to(model.start, (len(order), STATES))
    live = len(order)
    negative = -lengths
    for t in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(negative, -t, side="left"))  # sequences longer than t
        seen = model.emissions[classes[begins[:live] + t]]
        state = (state[:live] if t == 0 else state[:live] @ model.moves) * seen
        scale = state.sum(axis=1)
        state /= scale[:, None]
        out[:live] += np.log10(scale)
    result = np.empty(len(order))
    result[order] = out
    return result


def expected_counts(classes: np.ndarray, starts: np.ndarray, first: np.ndarray, model: Model) -> tuple[np.ndarray, ...]:
    """Baum-Welch counts (start, moves, emissions) of sequences; ``first`` marks starts of texts."""
    return likely_counts(classes, starts, first, model)[:3]


def likely_counts(
    classes: np.ndarray, starts: np.ndarray, first: np.ndarray, model: Model, held: int | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """``expected_counts`` and the log-likelihood (natural).

    Exact for sequences of any length: steps fall into windows of about
    ``held`` tokens. A first pass keeps the states at their starts, from which
    the windows are then run from last to first, each handing its backward
    values to the one before; only one window's states are held.
    """
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    begins, lengths, first = starts[:-1][order], lengths[order], first[order]
    steps = int(lengths[0])
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")
    window = (np.cumsum(live) - 1) // (held or TRAIN_HELD)
    cuts = np.append(np.flatnonzero(np.diff(window, prepend=-1)), steps)
    emissions = model.emissions.astype(np.float32)
    moves = model.moves.astype(np.float32)
    stationary = np.linalg.matrix_power(model.moves, 64).mean(axis=0)

    added = np.ones((STATES, 1), dtype=np.float32)  # a product with it adds up a row
    # Rows of a window lie by step: step t has the live sequences, from ends[t - 1] to ends[t].
    ends = np.append(0, np.cumsum(live))

    def filtered(state: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, ...]:
        """Classes, emissions, states and scales of a window that ``state`` comes before."""
        at = ends[begin : end + 1] - ends[begin]
        step_of = np.repeat(np.arange(end - begin), live[begin:end])
        who = np.arange(at[-1]) - at[step_of]
        which = classes[begins[who] + (step_of + begin)]
        seen = emissions[which]
        states, scales = np.empty_like(seen), np.empty((len(seen), 1), dtype=np.float32)
        for t, (low, high) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            now = states[low:high]
            if t + begin:
                np.matmul(state[: high - low], moves, out=now)
                now *= seen[low:high]
            else:
                np.multiply(state, seen[low:high], out=now)
            scale = np.matmul(now, added, out=scales[low:high])
            now /= scale
            state = now
        return at, step_of, who, which, seen, states, scales

    state = np.where(first[:, None], model.start, stationary).astype(np.float32)
    heads = [state]
    for begin, end in zip(cuts[:-2], cuts[1:-1]):
        states = filtered(heads[-1], begin, end)[5]
        heads.append(states[len(states) - live[end - 1] :].copy())
    size = len(model.emissions)
    move_counts, start_counts, emitted, gained = np.zeros((STATES, STATES)), np.zeros(STATES), np.zeros((size, STATES)), 0.0
    back, turned = np.ones((0, STATES), dtype=np.float32), np.ascontiguousarray(moves.T)
    for k in range(len(heads) - 1, -1, -1):
        begin, end = cuts[k], cuts[k + 1]
        at, step_of, who, which, seen, states, scales = filtered(heads[k], begin, end)
        gained += float(np.log(scales).sum(dtype=np.float64))
        # Backward values; sequences that end at a step have 1. Emissions turn into what goes on to the step before.
        behind = np.ones_like(seen)
        behind[at[-2] : at[-2] + len(back)] = back
        seen /= scales
        places = at.tolist()
        for t in range(end - begin - 1, -1, -1):
            low, high = places[t], places[t + 1]
            onward = seen[low:high]
            onward *= behind[low:high]
            if t:
                np.matmul(onward, turned, out=behind[places[t - 1] : places[t - 1] + high - low])
        back = seen[: at[1]] @ turned
        gamma = states * behind
        gamma /= gamma @ added
        for s in range(STATES):
            emitted[:, s] += np.bincount(which, weights=gamma[:, s], minlength=size)
        if begin:
            move_counts += heads[k][: at[1]].T @ seen[: at[1]]
        else:
            start_counts += gamma[: at[1]][first[: at[1]]].sum(axis=0)
        before = at[np.maximum(step_of - 1, 0)] + who
        for low in range(at[1], len(seen), PRODUCT_ROWS):
            part = slice(low, low + PRODUCT_ROWS)
            move_counts += states[before[part]].T @ seen[part]
    return start_counts, move_counts * model.moves, emitted, gained


def baum_welch_step(texts: DataFrame, known: Vocabulary, model: Model) -> tuple[Model, float]:
    """One round over all ``texts`` (ranks): counts per task, summed by Spark, then normalised; and ``model``'s log-likelihood."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast((model.start, model.moves, model.emissions))
    meta = Vocabulary(known.table.slice(0, 0), known.counts[:EMITTED], known.tokens, known.distinct, known.texts)
    names = [f"s{s}" for s in range(STATES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = Model(*sent.value)
        size = len(current.emissions)
        total = np.zeros((size + STATES + 2, STATES))
        for batch in batches:
            # Texts of like length run together: few steps for most of them, and one window, which needs no pass for its start.
            lengths = np.asarray(pc.list_value_length(batch.column("ranks")), dtype=np.int64) + 1
            order = np.argsort(lengths, kind="stable")
            lengths, at = lengths[order], 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), TRAIN_HELD, side="right")))
                classes, starts = _sequences(batch.column("ranks").take(pa.array(order[at : at + n])), meta)
                start, moves, emitted, gained = likely_counts(classes, starts, np.ones(n, dtype=bool), current)
                total[:size] += emitted
                total[size : size + STATES] += moves
                total[-2] += start
                total[-1, 0] += gained
                at += n
        there = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(there, pa.int32()), *(pa.array(total[there, s]) for s in range(STATES))], names=["item", *names]
        )

    schema = "item int, " + ", ".join(f"{n} double" for n in names)
    sums = texts.select("ranks").mapInArrow(run, schema).groupBy("item").agg(*[F.sum(n).alias(n) for n in names])
    table = sums.toArrow()  # at most EMITTED + STATES + 4 rows
    size = len(model.emissions)
    total = np.zeros((size + STATES + 2, STATES))
    total[np.asarray(table.column("item"))] = np.stack([np.asarray(table.column(n)) for n in names], axis=1)
    emitted = total[:size] + PRIOR_WORDS * known.prior()[:, None]
    moves = total[size : size + STATES] + PRIOR_MOVES
    start = total[-2] + PRIOR_MOVES
    return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0)), float(total[-1, 0])


def train(texts: DataFrame, known: Vocabulary, warm_rounds: int = WARM_ROUNDS, rounds: int = ROUNDS) -> Model:
    """Baum-Welch on all ``texts`` (ranks): ``warm_rounds``, then up to ``rounds`` while the likelihood gains ``GAIN`` a token."""
    model, before = first_model(known), -np.inf
    if not known.texts:
        return model
    for done in range(warm_rounds + rounds):
        following, reached = baum_welch_step(texts, known, model)
        gained, model, before = reached - before, following, reached
        if done >= warm_rounds and gained < GAIN * known.tokens:
            break
    return model


def scored(rows: DataFrame, known: Vocabulary, model: Model) -> DataFrame:
    """Per row of ``rows`` (as ``encoded`` gives them): tokens, and what the table's words add to the scores."""
    sent = rows.sparkSession.sparkContext.broadcast((model.start, model.moves, model.emissions, known.counts))
    meta = Vocabulary(known.table.slice(0, 0), known.counts[:EMITTED], known.tokens, known.distinct, known.texts)
    total, mass = known.total, known.other_mass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, counts = sent.value
        current = Model(*parts)
        base = np.append(np.log10((counts + ADDED) / total), 0.0)  # the last stands for words without a rank
        given = np.append(np.log10((counts + ADDED) / mass), 0.0)
        given[: meta.emitted] = 0.0  # emitted by themselves
        end = np.log10((meta.texts + ADDED) / total)
        for batch in batches:
            lengths = np.asarray(pc.list_value_length(batch.column("ranks")), dtype=np.int64)
            group = (np.cumsum(lengths + 1) - 1) // SCORE_TOKENS
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                part = batch.slice(int(at[0]), len(at))
                column = part.column("ranks")
                classes, starts = _sequences(column, meta)
                ranks = np.asarray(pc.list_flatten(column), dtype=np.int64)
                text_of = np.repeat(np.arange(len(at)), lengths[at])
                add = lambda w: np.bincount(text_of, weights=w, minlength=len(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("row", "doc_id", "held_out")),
                        pa.array(lengths[at] + 1, pa.int64()),
                        pa.array(add(ranks >= 0).astype(np.int64) + (meta.texts > 0), pa.int64()),
                        pa.array(add(base[ranks]) + end),
                        pa.array(forward(classes, starts, current) + add(given[ranks])),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model"],
                )

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double"
    return rows.select("row", "doc_id", "held_out", "ranks").mapInArrow(run, schema)


def other_words(rows: DataFrame, counts: DataFrame, known: Vocabulary) -> DataFrame:
    """Per row, what words outside the table add: their counts come from a join."""
    entry = rows.select("row", F.explode("others").alias("o")).select("row", F.col("o.word").alias("word"), F.col("o.n").alias("n"))
    c = F.coalesce("c", F.lit(0))
    met = entry.join(counts, "word", "left")
    return met.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known_others"),
        F.sum(F.col("n") * F.log10((c + ADDED) / F.lit(known.total))).alias("base_others"),
        F.sum(F.col("n") * F.log10((c + ADDED) / F.lit(known.other_mass))).alias("model_others"),
    )


def score_documents(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text; further columns are ignored).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1
    unigram) and score (the model's log10 probability). Learns from the rows
    that are not held out. NULL reads as the empty text, one end. Rows that
    repeat a doc_id are scored one by one; a row without a doc_id is trained
    on. With nothing to train on, every token is unseen. Empty input, empty
    result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    training = docs.where(~F.col("held_out"))
    counts = stored(word_counts(training), "counts")
    known = vocabulary(counts, training.select("doc_id").count())
    rows = stored(encoded(docs.withColumn("row", F.monotonically_increasing_id()), known), "encoded")
    model = train(rows.where(~F.col("held_out")), known)
    joined = scored(rows, known, model).join(other_words(rows, counts, known), "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "known_others").alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"), plus("base", "base_others").alias("base_score"),
        plus("model", "model_others").alias("score"),
    )
