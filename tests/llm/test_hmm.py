import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from voxelfield.llm import hmm
from tests.llm.conftest import MESSY, frame

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 2)
    rng = np.random.default_rng(4)
    simplex = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1] or None)
    return hmm.Model(simplex(2), simplex(2, 2), simplex(2, 5).T)


def paths(sequence, model):
    """Probability and joint weight of every state path."""
    for path in itertools.product(range(2), repeat=len(sequence)):
        p = model.start[path[0]]
        for a, b in zip(path, path[1:]):
            p *= model.moves[a, b]
        for s, o in zip(path, sequence):
            p *= model.emissions[o, s]
        yield path, p


def test_forward_sums_all_paths(small):
    rng = np.random.default_rng(1)
    sequences = [rng.integers(0, 5, n) for n in (1, 6, 3, 8, 1)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    found = hmm.forward(np.concatenate(sequences), starts, small)
    for s, f in zip(sequences, found):
        assert f == pytest.approx(math.log10(sum(p for _, p in paths(s, small))))


def test_counts_are_expectations_over_all_paths(small):
    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, 5, n) for n in (5, 1, 7, 3)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    start, moves, emitted = hmm.expected_counts(np.concatenate(sequences), starts, np.ones(4, dtype=bool), small)
    wanted = np.zeros(2), np.zeros((2, 2)), np.zeros((5, 2))
    for s in sequences:
        total = sum(p for _, p in paths(s, small))
        for path, p in paths(s, small):
            wanted[0][path[0]] += p / total
            for a, b in zip(path, path[1:]):
                wanted[1][a, b] += p / total
            for state, o in zip(path, s):
                wanted[2][o, state] += p / total
    for a, b in zip((start, moves, emitted), wanted):
        assert np.allclose(a, b, atol=1e-4)


def test_windows_pass_states_on(small):
    """Counts of whole texts do not depend on how many tokens are held at once; no move is dropped."""
    rng = np.random.default_rng(5)
    lengths = [700, 1, 256, 257, 40, 300]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    classes, first = rng.integers(0, 5, starts[-1]), np.ones(len(lengths), dtype=bool)
    whole = hmm.likely_counts(classes, starts, first, small, held=1 << 20)
    logs = hmm.forward(classes, starts, small).sum() * math.log(10)
    for held in (1, 100, 257):
        for a, b in zip(hmm.likely_counts(classes, starts, first, small, held=held), whole):
            assert np.allclose(a, b, rtol=1e-4)
    assert whole[1].sum() == pytest.approx(sum(lengths) - len(lengths), rel=1e-4) and whole[3] == pytest.approx(logs, rel=1e-4)


def test_every_round_covers_all_rows(spark, monkeypatch):
    """Each round counts every token and every move, in corpora of more rows than any sample, long texts included."""
    seen, step = [], hmm.baum_welch_step
    rows = [(i, f"a{i % 50} b{i % 7} c", "en", "s") for i in range(2600)] + [(2600, "x y z " * 200, "en", "s")]
    monkeypatch.setattr(hmm, "baum_welch_step", lambda texts, known, model: seen.append(texts.count()) or step(texts, known, model))
    train = sum(zlib.crc32(str(i).encode()) % 10 != 0 for i, *_ in rows)
    hmm.score_documents(frame(spark, rows))
    assert len(seen) > hmm.WARM_ROUNDS and set(seen) == {train}


def test_long_texts_do_not_underflow(small):
    sequence = np.random.default_rng(3).integers(0, 5, 50_000)
    whole = hmm.forward(sequence, np.array([0, len(sequence)]), small)[0]
    assert -50_000 < whole < -10_000


def test_scores_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: tokens(r.text) for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts, trained = Counter(), 0
    for i, t in texts.items():
        if not held[i]:
            counts.update(t)
            trained += 1
    total, distinct = sum(counts.values()) + trained, len(counts) + 1
    below = total + 0.1 * (distinct + 1)
    found = hmm.score_documents(docs).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        t = texts[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / below) for w in t) + math.log10((trained + 0.1) / below)
        assert r.base_score == pytest.approx(base) and r.held_out == held[r.doc_id] and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(t) + 1, sum(counts[w] > 0 for w in t) + 1)
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_classes_share_one_probability(spark, monkeypatch):
    """Start, emissions and the class of other words are proper distributions, also with a tiny table."""
    monkeypatch.setattr(hmm, "TABLE_WORDS", 6)
    monkeypatch.setattr(hmm, "EMITTED", 4)
    monkeypatch.setattr(hmm, "WARM_ROUNDS", 1)
    rows = [(i, f"the cat sat on mat {'x' * (i % 7)} word{i % 5}", "en", "s") for i in range(40)]
    docs = frame(spark, rows)
    train = [tokens(t) for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in t)
    known = hmm.vocabulary(hmm.word_counts(docs.where(~hmm.held_out())), len(train))
    prior = known.prior()
    assert prior.sum() == pytest.approx(1) and len(known.counts) == 6
    top = set(known.table.to_pylist()[:4])
    rest = sum(c + 0.1 for w, c in counts.items() if w not in top) + 0.1
    assert known.other_mass == pytest.approx(rest)
    total = sum(counts.values()) + len(train)
    below = total + 0.1 * (len(counts) + 2)
    for r in hmm.score_documents(docs).collect():
        base = sum(math.log10((counts[w] + 0.1) / below) for w in tokens(rows[r.doc_id][1])) + math.log10((len(train) + 0.1) / below)
        assert r.base_score == pytest.approx(base) and r.score < 0


def test_messy(messy, empty):
    found = hmm.score_documents(messy).collect()
    assert len(found) == len(MESSY)
    sizes = sorted((r.doc_id or -1, r.n_tokens) for r in found)
    assert sizes == sorted((i or -1, len(tokens(t)) + 1) for i, t, *_ in MESSY)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in found)
    same = {r.score for r in found if r.doc_id == 9}
    assert len(same) == 1
    assert hmm.score_documents(empty).collect() == []


def test_nothing_to_train_on(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    found = hmm.score_documents(frame(spark, [(held, "a b", "en", "s")])).collect()[0]
    assert (found.train_tokens, found.n_known, found.n_tokens) == (0, 0, 3) and math.isfinite(found.score)
