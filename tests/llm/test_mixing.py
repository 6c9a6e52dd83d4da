import re
from collections import Counter

import numpy as np
import pytest

from voxelfield.llm import mixing
from tests.llm.conftest import MESSY, frame

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_by_hand():
    totals = np.array([1000.0, 10.0, 10.0, 0.0])
    found = mixing.targets(totals, np.array([5.0, 2.0, 1.0, 5.0]))
    assert found.tolist() == [1490.0, 20.0, 20.0, 0.0]
    assert mixing.targets(np.array([100.0, 100.0]), np.array([5.0, 2.0])).tolist() == [200.0, 100.0]


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        for key in (0, 5, 2**40 + 1):
            assert sorted(mixing.permuted(np.arange(n), n, key)) == list(range(n))
    order = mixing.permuted(np.arange(10_000), 10_000, 3)
    assert abs(np.corrcoef(np.arange(10_000), order)[0, 1]) < 0.05


def test_shards_meet_totals_and_are_random():
    slots = np.array([5000, 300, 7, 0])
    drawn = mixing.draw_shards(slots, 20, (1, 2))
    assert drawn.sum(axis=0).tolist() == slots.tolist() and drawn.min() >= 0
    assert drawn.sum(axis=1).max() - drawn.sum(axis=1).min() <= 1
    assert drawn[:, 1].std() > 0 and np.array_equal(drawn, mixing.draw_shards(slots, 20, (1, 2)))


def test_every_block_is_taken_equally_often(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 16)
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 3)
    table = [{"no": 0, "blocks": 50, "slots": 100}, {"no": 1, "blocks": 40, "slots": 55}, {"no": 2, "blocks": 3, "slots": 0}]
    rows = mixing.drawn_slots(spark, table).collect()
    for source in table:
        times = Counter(r.block for r in rows if r.no == source["no"])
        assert sum(times.values()) == source["slots"]
        low, rest = divmod(source["slots"], source["blocks"])
        assert Counter(times[b] for b in range(source["blocks"])) == {k: v for k, v in ((low, source["blocks"] - rest), (low + 1, rest)) if v}


def test_takings_meet_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    found = mixing.mix_sources(docs).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    sizes = {i: len(WORD.findall(r.text or "")) for i, r in texts.items()}
    source = Counter()
    for i, n in sizes.items():
        source[texts[i].source] += n
    taken, target = Counter(), {}
    for r in found:
        name = texts[r.doc_id].source
        assert r["size"] == sizes[r.doc_id] and r.source_size == source[name] and 0 <= r.taken <= 2 * r["size"]
        taken[name] += r.taken
        target[name] = r.target
    names = sorted(source)
    wanted = mixing.targets(np.array([float(source[n]) for n in names]), np.array([(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))]))
    for name, t in zip(names, wanted):
        assert target[name] == pytest.approx(t) and abs(taken[name] - t) <= mixing.BLOCK_WORDS
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()))


def test_documents_of_the_mix_hold_the_words_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    words, whole = Counter(), 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.schema == docs.schema
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        whole += r.text == texts[r.doc_id]
        assert r.n_chars == len(r.text) and set(r.text.split()) <= set(texts[r.doc_id].split())
    assert {i: n for i, n in words.items() if n} == {i: r.taken for i, r in taken.items() if r.taken}
    assert whole >= 2 * sum(r.taken == 2 * r["size"] > 0 for r in taken.values())


def test_copies_keep_white_space():
    text = " a b\n\nc  d e "
    assert mixing.copies(text, [(0, 5, 2)]) == [text, text]
    assert mixing.copies(text, [(0, 2, 1), (2, 2, 2), (4, 1, 0)]) == [" a b\n\nc  d ", "c  d "]


def test_messy(spark, messy, empty):
    found = mixing.mix_sources(messy).collect()
    assert len(found) == len(MESSY)
    assert all(r.taken <= 2 * r["size"] for r in found)
    assert all(r["size"] == 0 == r.taken for r in found if r.doc_id in (4, 5, 6))
    assert mixing.mix_sources(empty).collect() == []
    mixed = mixing.mixed_documents(messy)
    assert mixed.columns == messy.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert (r.row, r["size"], r.node, r.no) == (7, 1, "n", 3)
    wanted = Counter()
    for r in found:
        wanted[r.doc_id] += r.taken
    assert +words == +wanted
    assert mixing.mixed_documents(empty).collect() == []
    blank = frame(spark, [(1, "", "en", "a"), (2, None, "en", None)])
    assert sorted((r.doc_id, r.taken, r.target) for r in mixing.mix_sources(blank).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]
