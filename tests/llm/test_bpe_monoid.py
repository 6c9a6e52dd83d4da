import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelfield.llm import bpe_monoid
from tests.llm.conftest import LONG, MESSY

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def table():
    return bpe_monoid.ByteTable(bpe_monoid.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(table):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table.ranks, special_tokens={})


def check(table, library, text):
    ids = table.encode(text)
    assert ids.tolist() == library.encode_ordinary(text), text[:80]
    assert table.decode(ids) == text.encode()


RUNS = ["a" * 5000, "ab" * 3001, "abc" * 2000, "=" * 999, "-_" * 700, "é" * 801, "中文" * 900, "😀" * 300, "1234567890" * 500, " " * 1001,
        "\n" * 777, "\t \n" * 300, "x \n\n  y　z\x1c\x1d a\x85b", "aaab" * 1111, "word" * 2500, "don't we'll I'm" * 9, LONG, "", "\x00"]


@pytest.mark.parametrize("text", RUNS)
def test_runs(table, library, text):
    check(table, library, text)


def test_random_texts(table, library):
    rng = random.Random(5)
    alphabets = ["ab", "abc ", "etaoin shrdlu", "aé中 \n", "".join(map(chr, range(32, 127))), "".join(chr(rng.randrange(0x20, 0x3000)) for _ in range(300))]
    for _ in range(600):
        letters = rng.choice(alphabets)
        check(table, library, "".join(rng.choice(letters) for _ in range(rng.choice((3, 20, 200, 2000)))))


@settings(max_examples=300, deadline=None)
@given(text=st.text())
def test_any_text(table, library, text):
    check(table, library, text)


def test_join_is_associative_with_identity(table):
    rng = random.Random(6)
    for _ in range(300):
        parts = [bytes(rng.choice(b"abcde ther") for _ in range(rng.randrange(0, 60))) for _ in range(3)]
        a, b, c = (table.merged(p) for p in parts)
        whole = table.merged(b"".join(parts))
        assert table.join(table.join(a, b), c) == whole == table.join(a, table.join(b, c))
        assert table.join([], a) == a == table.join(a, [])


def test_merges_agree(table):
    rng = random.Random(7)
    for _ in range(300):
        data = bytes(rng.choice(b"aabbc the") for _ in range(rng.randrange(0, bpe_monoid.SCANNED)))
        assert table.merged(data) == table._merged_by_heap(data)
    parts = [bytes(rng.choice(b"aabbc the\xc3\xa9") for _ in range(rng.randrange(1, bpe_monoid.LEAF + 1))) for _ in range(9000)]
    for part, ids in zip(parts, table.merged_in_step(parts)):
        assert np.frombuffer(ids, np.uint32).tolist() == table.merged(part)
    assert table.merged_in_step([]) == []


def test_stretches_never_cut_a_match():
    rng = random.Random(8)
    letters = "ab1'! \t\n\r\x0b\x1c\x1f\x85\xa0   　é中"
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 12)))
        cut = [m for s in bpe_monoid.STRETCH.findall(text) for m in regex.findall(public_tokenizers.PATTERN, s)]
        assert cut == regex.findall(public_tokenizers.PATTERN, text)


def test_messy_rows(messy, empty, library):
    encode = lambda df: bpe_monoid.encode_documents(df, PATH, public_tokenizers.PATTERN, ["doc_id"])
    found = sorted((tuple(r) for r in bpe_monoid.digest_columns(encode(messy)).collect()), key=str)
    truth = []
    for doc_id, text, *_ in MESSY:
        ids = library.encode_ordinary(text or "")
        truth.append((doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(truth, key=str)
    assert encode(empty).collect() == []
