import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelfield.llm import sp_encoding
from tests.llm.conftest import MESSY

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces():
    return sp_encoding.PieceTable(PATH)


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_texts_of_all_kinds(pieces):
    rng = random.Random(1)
    parts = ["a", "ab", " ", "  ", "\n", "the", "▁", "é", "ß", "中文", "😀", "\x00", "́", "23", "...", "<s>", "</s>", "<unk>", "<0x41>",
             "\t", "aaaa", "�", "\r\n", "==", "     ", " ", "tion", "er"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        ids = LIBRARY.encode(text, add_eos=True)
        assert pieces.encode(text).tolist() == ids and pieces.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    pieces = test_any_text.__dict__.setdefault("pieces", sp_encoding.PieceTable(PATH))
    text = text.encode("utf-8", "ignore").decode()
    assert pieces.encode(text).tolist() == LIBRARY.encode(text, add_eos=True)


def test_any_ids_decode(pieces):
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.randrange(0, 32000) if rng.random() < 0.5 else rng.randrange(0, 259) for _ in range(rng.randint(0, 12))]
        assert pieces.decode(ids) == LIBRARY.decode(ids)


def test_last_token_is_that_of_every_prefix(pieces):
    text = "internationalisation"
    for n in range(1, len(text) + 1):
        assert pieces.encode_run(text[:n]) == [pieces.ids[p] for p in pieces.merge(text[:n])[0]]


def test_small_memory_changes_nothing(pieces, monkeypatch):
    monkeypatch.setattr(sp_encoding, "REMEMBERED", 3)
    monkeypatch.setattr(sp_encoding, "REMEMBERED_PAIRS", 5)
    text = "a short text with several different words and a long one " * 20
    fresh = sp_encoding.PieceTable(PATH)
    assert fresh.encode(text).tolist() == LIBRARY.encode(text, add_eos=True)


def test_long_text_without_spaces(pieces):
    text = "abcdefghijklmnopqrstuvwxyz0123456789" * 3000
    assert pieces.encode(text).tolist() == LIBRARY.encode(text, add_eos=True)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in sp_encoding.digest_columns(sp_encoding.encode_documents(docs, PATH, ["doc_id"])).collect():
        ids = LIBRARY.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_messy(messy, empty):
    found = sp_encoding.encode_documents(messy, PATH, ["doc_id", "size"]).collect()
    assert sorted((r.doc_id or -1, list(r.ids)) for r in found) == sorted((i or -1, LIBRARY.encode(t or "", add_eos=True)) for i, t, *_ in MESSY)
    assert sp_encoding.encode_documents(empty, PATH, ["doc_id"]).collect() == []
