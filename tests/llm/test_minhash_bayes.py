import random
import re

import numpy as np
import pyarrow as pa
import pytest

from voxelfield.llm import minhash_bayes as mb
from voxelfield.llm.components import connected_components
from voxelfield.llm.text import shingle_sets
from tests.llm.conftest import MESSY, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_classes(rows):
    """Class of each row by comparing all pairs."""
    sets = [plain_set(t) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and 100 * len(a & b) >= 75 * len(a | b):
                label[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return [least[find(i)] for i in range(len(rows))], [len(s) for s in sets]


def corpus(n, seed):
    """Chains of copies that drift apart, passages many texts share, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.5:
            words = list(texts[rng.randrange(len(texts))])
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice((3, 5, 8, 40, 120)))]
            if rng.random() < 0.3:
                words += passage
        texts.append(words)
    return [(1000 - i, " ".join(t), "en", "s") for i, t in enumerate(texts)]


def test_shingles_against_tuples():
    texts = [t for _, t, *_ in MESSY] + ["a b c d", "a b c d e", "a a a a a a a", "b a c d e"]
    found = shingle_sets(pa.array(texts))
    names = {}
    for text, hashed in zip(texts, found):
        assert len(hashed) == len(plain_set(text))
        key = frozenset(plain_set(text))
        assert names.setdefault(key, hashed.tobytes()) == hashed.tobytes()
    assert len(set(names.values())) == len(names)


def test_needed_matches_bound_the_miss():
    needed = mb.fewest_matches()
    rng = np.random.default_rng(0)
    kept = 0
    for _ in range(2000):
        draws = rng.random(mb.HASHES) < 0.75
        kept += all(draws[:n].sum() >= m for n, m in needed)
    assert kept == 2000 and needed[-1][1] > 0.5 * mb.HASHES


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (10, 150, 300):
        pool = rng.integers(0, 2**63, 600).astype(np.uint64)
        a, b = pool[:300], np.concatenate([pool[:share], pool[300 : 600 - share]])
        true = share / (600 - share)
        assert abs((mb.signature(np.unique(a)) == mb.signature(np.unique(b))).mean() - true) < 0.12


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 60), 100 + rng.randint(0, 60)) for _ in range(45)] + [(7, 7), (500, 400)]
    label = {}

    def find(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in label}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(mb, "BLOCK", 16)  # several blocks per bucket
    rows = corpus(260, seed)
    label, sizes = plain_classes(rows)
    found = {r.doc_id: r for r in mb.near_duplicates(frame(spark, rows)).collect()}
    for (i, *_), component, n in zip(rows, label, sizes):
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (n, component, i == component)


def test_block_links_join_what_touches():
    """Without any pivot round, blocks alone give the components."""
    rows = corpus(120, 5)
    sets = [s for s in shingle_sets(pa.array([t for _, t, *_ in rows])) if len(s)]
    block = pa.table({
        "component": pa.array([str(i).encode() for i in range(len(sets))], pa.binary()), "side": pa.array([0] * len(sets), pa.int32()),
        "signature": pa.array([mb.signature(s).astype(np.uint8).tobytes() for s in sets], pa.binary()),
        "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
    })
    label = list(range(len(sets)))
    for i, j in mb.block_links(block, mb.fewest_matches(), 75):
        assert mb.similar(sets[i], sets[j])
        a, b = label[i], label[j]
        label = [a if x == b else x for x in label]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert not mb.similar(a, b) or label[i] == label[j]


def test_messy(messy, empty):
    found = mb.near_duplicates(messy).collect()
    label, sizes = plain_classes(MESSY)
    key = lambda r: tuple((x is None, x) for x in r)
    wanted = []
    for (i, *_), component, n in zip(MESSY, label, sizes):
        component = component if n else i
        wanted.append((i, n, component, i == component))
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)
    assert mb.near_duplicates(empty).collect() == []
