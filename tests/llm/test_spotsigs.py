import hashlib

import numpy as np
import pyarrow as pa

from voxelfield.llm import spotsigs
from tests.llm.conftest import MESSY, frame


def test_spots_by_hand():
    sets = spotsigs.spot_sets(pa.array(["The cat sat of a mat today", "the CAT, sat of a mat today!", "cat sat", "", None, "?!"]))
    # Start of text, "the" and "of" each begin a chain.
    assert len(sets[0]) == 3
    assert np.array_equal(sets[0], sets[1])
    assert len(sets[2]) == 1 and len(sets[3]) == 1 and np.array_equal(sets[3], sets[4])
    assert not np.array_equal(sets[3], sets[5])


def test_spots_cover_texts_and_stretches_without_anchors():
    """Wherever a run of words differs, fingerprints differ, with few anchors or none."""
    plain = [f"слово{i}" for i in range(400)]
    for words in (plain, ["the", *plain], [*plain[:200], "of", *plain[200:]], plain[:9]):
        for at in range(0, len(words) - 3, 5):
            other = [*words[:at], "eins", "zwei", "drei", "vier", *words[at + 4 :]]
            a, b = spotsigs.spot_sets(pa.array([" ".join(words), " ".join(other)]))
            assert not np.array_equal(a, b) and spotsigs.pruned_jaccard(a, b) < 1
    half = spotsigs.spot_sets(pa.array([" ".join(plain), spotsigs.edited(" ".join(plain), "x " * 2000)]))
    assert 0.3 < spotsigs.pruned_jaccard(*half) < 0.7


def test_likeness_is_jaccard_and_pruning_is_safe():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint32)) for _ in range(2))
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        assert spotsigs.pruned_jaccard(a, b) == true
        assert spotsigs.pruned_jaccard(a, b, 0.5) in (true, 0.0) if true < 0.5 else spotsigs.pruned_jaccard(a, b, 0.5) == true
        assert np.array_equal(spotsigs.read(spotsigs.written(a)), a)


def test_length_partitions_hold_similar_sets():
    bounds = spotsigs.length_bounds(0.75, 500)
    part = lambda n: max(i for i, b in enumerate(bounds) if b <= n)
    for n in range(1, 500):
        for m in range(n, min(500, int(n / 0.75) + 1)):
            assert m * 0.75 > n or part(m) - part(n) <= 1


def test_next_and_edited(spark, messy):
    found = spotsigs.fingerprints_with_next(messy).collect()
    assert len(found) == len(MESSY)
    line = sorted(((i, t or "") for i, t, *_ in MESSY), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    wanted = []
    for (i, text), (_, following) in zip(line, line[1:] + line[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        wanted.append((i or 0, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in found) == sorted(wanted)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    by_text = {}
    for r, (i, t) in zip(sorted(found, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.n_chars)), line):
        by_text.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert len(by_text[len("one two")]) == 1


def test_many_blocks_agree_with_one(spark):
    rows = [(i * 7 % 1000, f"the word{i} has number {i * 13 % 101} of many words for block {i % 5}", "en", "s") for i in range(1000)]
    docs = frame(spark, rows)
    texts = dict((i, t) for i, t, *_ in rows)
    ids = sorted(texts, reverse=True)
    following = dict(zip(ids, ids[1:] + ids[:1]))
    for r in spotsigs.fingerprints_with_next(docs).collect():
        own, other = spotsigs.spot_sets(pa.array([texts[r.doc_id], texts[following[r.doc_id]]]))
        assert r.fingerprint == spotsigs.written(own) and r.near_next == spotsigs.pruned_jaccard(own, other)


def test_empty(empty):
    assert spotsigs.fingerprints_with_next(empty).collect() == []


def test_classes_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    sets = []
    for i in range(120):
        base = sets[rng.integers(0, len(sets))] if sets and i % 3 else set(rng.integers(0, 4000, 40).tolist())
        sets.append(set(base) - set(list(base)[: i % 4]) | set(rng.integers(0, 4000, i % 5).tolist()))
    rows = [(i, spotsigs.written(np.array(sorted(s), dtype=np.uint32))) for i, s in enumerate(sets)]
    label = list(range(len(sets)))
    for _ in range(len(sets)):
        before = list(label)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if len(a & b) >= 0.75 * len(a | b):
                    label[i] = min(label[i], label[j])
        if before == label:
            break
    found = spotsigs.similar_classes(spark.createDataFrame(rows, "doc_id long, fingerprint string"))
    assert {r.doc_id: r.class_id for r in found.collect()} == dict(enumerate(label))
