import hashlib
import random
from collections import defaultdict

from voxelfield.llm import cuckoo
from voxelfield.llm.storage import stored
from tests.llm.conftest import MESSY, frame


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_filter_against_a_dictionary():
    shard, truth, rng = cuckoo.Shard(4), {}, random.Random(1)
    for step in range(20_000):
        i = rng.randint(0, 3000)
        if rng.random() < 0.7:
            shard.insert(key(i), step)
            truth[i] = (step, truth[i][1] + 1) if i in truth else (step, 1)
        else:
            assert shard.delete(key(i)) == (i in truth)
            truth.pop(i, None)
    for i in range(3001):
        entry = shard.find(key(i))
        assert (entry and (entry[1], entry[2])) == truth.get(i)
    assert shard.resizes > 3 and len(shard.content) == len(truth)


def test_hits_are_verified():
    """Digests with one fingerprint and bucket are told apart by the stored content."""
    digests = [b"\0" * 8 + b"\0\1" + bytes([i]) + b"\0" * 21 for i in range(6)]
    shard = cuckoo.Shard()
    for i, d in enumerate(digests[:5]):
        shard.insert(d, i)
    assert shard.false_hits > 0 and [shard.find(d)[1] for d in digests[:5]] == [0, 1, 2, 3, 4]
    assert shard.find(digests[5]) is None
    assert shard.delete(digests[2]) and shard.find(digests[2]) is None and shard.find(digests[3])[1] == 3


def test_overflow_resizes_from_stored_keys():
    shard = cuckoo.Shard(1)
    for i in range(500):
        shard.insert(key(i), i)
    assert shard.buckets >= 128 and all(shard.find(key(i))[1] == i for i in range(500))


def test_index_over_several_deliveries(spark):
    rows = lambda ids: spark.createDataFrame([(i, bytearray(key(i % 400))) for i in ids], "doc_id long, digest binary")
    index = stored(cuckoo.insert(cuckoo.empty_index(spark), rows(range(300)), 3), "index")
    index = stored(cuckoo.insert(index, rows(range(200, 900)), 3), "index")
    index = stored(cuckoo.delete(index, rows(range(100, 150)), 3), "index")
    truth = defaultdict(list)
    for i in [*range(300), *range(200, 900)]:
        truth[i % 400].append(i)
    for i in range(100, 150):
        truth.pop(i)
    found = {bytes(r.digest): (r.owner, r.copies) for r in index.collect()}
    assert found == {key(k): (max(v), len(v)) for k, v in truth.items()}
    looked = {r.doc_id: r.owner for r in cuckoo.lookup(index, rows(range(395)), 3).collect()}
    assert looked == {i: max(truth[i]) if i in truth else None for i in range(395)}


def test_hot_digest_and_messy_rows(spark, messy, empty):
    found = cuckoo.exact_duplicates(messy).collect()
    assert len(found) == len(MESSY)
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, text, *_ in MESSY:
        groups[hashlib.sha256((text or "").translate(table).encode()).hexdigest()].append(i)
    for r in found:
        own = groups[r.text_sha256]
        keep = max((i for i in own if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(own), r.doc_id == keep) and r.doc_id in own
    assert cuckoo.exact_duplicates(empty).collect() == []
    hot = frame(spark, [(i, "same" if i % 3 else f"own {i}", "en", "s") for i in range(600)])
    sizes = {r.doc_id: (r.keep_id, r.group_size) for r in cuckoo.exact_duplicates(hot).collect()}
    assert sizes[1] == (599, 400) and sizes[3] == (3, 1) and len(sizes) == 600
