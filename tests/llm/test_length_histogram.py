import numpy as np
import public_tokenizers

from voxelfield.llm import length_histogram as lh
from voxelfield.llm import queries
from tests.llm.conftest import MESSY

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def check(rows, lengths):
    """Suffix sums of one group against numpy."""
    x = np.array(lengths)
    assert sorted(r.length for r in rows) == sorted(set(lengths))
    for r in rows:
        k = r.length
        assert (r.n, r.documents, r.tokens) == ((x == k).sum(), len(x), x.sum())
        assert (r.docs_from, r.tokens_from) == ((x >= k).sum(), x[x >= k].sum())
        assert r.truncated_tokens == np.minimum(x, k).sum() and abs(r.share_upto - (x <= k).mean()) < 1e-12


def test_query_against_numpy(spark):
    known = lh.encoding(PATH, public_tokenizers.PATTERN)
    by_source = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        by_source.setdefault(r.source, []).append(len(known.encode_ordinary(r.text or "")))
    found = queries.op9_length_histogram(spark, SF).collect()
    for source, lengths in by_source.items():
        check([r for r in found if r.source == source], lengths)


def test_limits_and_quantiles(spark):
    rng = np.random.default_rng(0)
    lengths = rng.integers(0, 5000, 400).tolist() + [0, 0, 1023, 1024, 1025, 90_000]
    sums = lh.suffix_sums(lh.histogram(spark.createDataFrame([(n,) for n in lengths], "length int"))).cache()
    check(sums.collect(), lengths)
    one = spark.range(1)
    for limit in (0, 1, 777, 1024, 10**6):
        assert one.select(lh.truncated_total(sums, limit).alias("t")).head().t == np.minimum(lengths, limit).sum()
    for level in (0.1, 0.5, 0.99, 1.0):
        assert one.select(lh.quantile(sums, level).alias("q")).head().q == np.quantile(lengths, level, method="inverted_cdf")


def test_messy(messy, empty):
    known = lh.encoding(PATH, public_tokenizers.PATTERN)
    rows = lh.suffix_sums(lh.histogram(lh.encoded_lengths(messy, PATH, public_tokenizers.PATTERN, ["source"]), ["source"]), ["source"]).collect()
    for source in {s for *_, s in MESSY}:
        check([r for r in rows if r.source == source], [len(known.encode_ordinary(t or "")) for _, t, _, s in MESSY if s == source])
    assert lh.suffix_sums(lh.histogram(lh.encoded_lengths(empty, PATH, public_tokenizers.PATTERN))).collect() == []
