import math
import random
import re
from collections import Counter

from voxelfield.llm import ranked_search
from tests.llm.conftest import MESSY, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(ranked_search.TERM, (text or "").translate(LOWER))


def expected(documents, queries, k=50):
    """Sorted (item_id, rank, doc_id, score) by scoring every document."""
    counted = [(doc_id, Counter(words(text))) for doc_id, text in documents]
    counted = [(doc_id, c) for doc_id, c in counted if c]
    size, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in queries:
        found = []
        for doc_id, c in counted:
            m = 100 - 50 + (50 * c.total() * size) // length
            score = 0
            for term in set(words(text)):
                if c[term]:
                    w = math.floor(1000 * math.log((2 * size + 2) / (2 * df[term] + 1)))
                    score += w * ((1000000000 * c[term]) // (1000 * c[term] + 20 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item_id, i + 1, doc_id, -score) for i, (score, _, doc_id) in enumerate(found[:k])]
    return sorted(out, key=str)


def run(spark, documents, queries, k=50, **more):
    asked = spark.createDataFrame([(*q, 1, "g", "s") for q in queries], "item_id long, text string, query long, `group` string, score string")
    found = ranked_search.search(documents, asked, k, **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_terms():
    for text in ("Äpfel & 12ÉÈ x_y\x00z　q", "", "ABC'd E\x7f"):
        assert [t.decode() for t in ranked_search.terms_of(text)] == words(text)


def corpus(n, seed=1):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(names, weights, k=rng.choice((3, 30, 300)))) for _ in range(n)]
    return [(i if i % 40 else None, texts[i // 3] if i % 3 == 1 else texts[i]) for i in range(n)]


def test_against_all_scores(spark):
    documents = corpus(900)
    rng = random.Random(2)
    queries = [(i % 9, " ".join(f"W{rng.randrange(0, 500)}" for _ in range(rng.choice((1, 4, 40))))) for i in range(12)] + [(50, None), (51, ""), (52, "zzz")]
    df = frame(spark, [(i, t, "en", "s") for i, t in documents]).repartition(3)
    truth = expected(documents, queries, 20)
    assert run(spark, df, queries, 20) == truth
    assert run(spark, df, queries, 20, pairs=60) == truth  # several passes


def test_blocks_keep_bounds_and_rows():
    import pyarrow as pa

    rng = random.Random(4)
    sizes = [rng.choice((0, 3, 2000)) for _ in range(20_000)]
    batch = pa.record_batch({"terms": pa.array([b"1234" * n for n in sizes[:20_000]], pa.large_binary()), "no": pa.array(range(20_000))})
    old = ranked_search.BLOCK_POSTINGS
    try:
        ranked_search.BLOCK_POSTINGS = 100_000
        made = list(ranked_search.blocks(iter([batch.slice(0, 9000), batch.slice(9000)])))
    finally:
        ranked_search.BLOCK_POSTINGS = old
    assert [i for t in made for i in t.column("no").to_pylist()] == list(range(20_000))
    assert all(t.num_rows <= ranked_search.BLOCK_DOCS for t in made)
    assert all(t.num_rows == 1 or sum(sizes[i] for i in t.column("no").to_pylist()) <= 100_000 for t in made)


def test_accumulators_stop_without_loss():
    """Small blocks with a bound from others give the same best documents as all scores."""
    import numpy as np

    rng = np.random.default_rng(3)
    docs, vocabulary = 4000, 300
    rows = [np.unique(rng.zipf(1.3, size=rng.integers(1, 60)) % vocabulary).astype(np.int32) for _ in range(docs)]
    counts = [rng.integers(1, 9, len(r)) for r in rows]
    sizes = np.array([c.sum() for c in counts])
    ids = np.arange(docs) // 2  # ties
    df = np.bincount(np.concatenate(rows), minlength=vocabulary)
    whole = ranked_search.Block(ids, sizes, [r.tobytes() for r in rows], [c.astype(np.int64).tobytes() for c in counts], docs, int(sizes.sum()))
    for _ in range(40):
        own = np.array(sorted(set(rng.integers(0, vocabulary, 12).tolist()) - set(np.flatnonzero(df == 0)), key=lambda t: df[t]), dtype=np.int32)
        query = ranked_search.Query(0, 0, own, np.floor(1000 * np.log((2 * docs + 2) / (2 * df[own] + 1))).astype(np.int64))
        scores = np.zeros(docs, np.int64)
        m = 50 + (50 * sizes * docs) // int(sizes.sum())
        for d, (r, c) in enumerate(zip(rows, counts)):
            for t, w in zip(query.terms, query.weights):
                at = np.searchsorted(r, t)
                if at < len(r) and r[at] == t:
                    scores[d] += w * ((1000000000 * c[at]) // (1000 * c[at] + 20 * m[d]))
        there = scores > 0
        truth = ranked_search.top(ids[there], scores[there], 10)
        for least in (0, int(truth[1][-1]) - 1, int(truth[1][-1])):
            found = whole.best(query, least, 10)
            assert found[0].tolist() == truth[0].tolist() and found[1].tolist() == truth[1].tolist()


def test_messy_rows(spark, messy, empty):
    queries = [(1, "one TWO alpha"), (1, "one TWO alpha"), (None, "zwei"), (3, "Éè 中文 w1x1")]
    assert run(spark, messy, queries) == expected([(i, t) for i, t, *_ in MESSY], queries)
    assert run(spark, empty, queries) == []
    assert run(spark, messy, []) == []
