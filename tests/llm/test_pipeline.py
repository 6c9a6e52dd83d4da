"""The stages one by one against brute force, and the whole."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline as cp
from tests.llm.conftest import MESSY, frame
from tests.llm.test_minhash_bayes import corpus, plain_classes

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    known = cp.language(spark, docs, SF)
    assert known.schema == docs.schema and {r.doc_id for r in known.collect()} == set(rows)  # all are prose

    single = cp.exact_dedup(spark, docs, SF)
    last = {}
    for i, r in sorted(rows.items()):
        last[(r.text or "").translate(LOWER)] = i
    got = {r.doc_id: r for r in single.collect()}
    assert single.schema == docs.schema and set(got) == set(last.values()) and all(got[i] == rows[i] for i in got)

    listed = [(i, r.text) for i, r in rows.items()]
    label, sizes = plain_classes(listed)
    apart = cp.near_dedup(spark, docs, SF)
    assert apart.schema == docs.schema
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for (i, _), c, n in zip(listed, label, sizes) if i == c or not n)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in cp.encode(spark, docs, SF).collect():
        ids = library.encode(rows[r.doc_id].text, add_eos=True)
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_one_of_each_messy_group_stays(spark, messy, empty):
    single = cp.exact_dedup(spark, messy, SF)
    assert single.columns == messy.columns
    texts = Counter((r.text or "").translate(LOWER) for r in single.collect())
    assert texts == Counter({(t or "").translate(LOWER): 1 for _, t, *_ in MESSY})
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_near_groups(spark):
    rows = corpus(80, 9)
    label, sizes = plain_classes(rows)
    kept = sorted(r.doc_id for r in cp.near_dedup(spark, frame(spark, rows), SF).collect())
    assert kept == sorted(i for (i, *_), c in zip(rows, label) if i == c)


def test_near_groups_without_ids(spark):
    """Of every class one row stays, also where none or only some of its rows have a doc_id."""
    rows = corpus(80, 9)
    label, sizes = plain_classes(rows)
    owner = {i: c for (i, *_), c in zip(rows, label)}
    bare = [(None if owner[i] % 2 else i if j % 3 else None, *rest) for j, (i, *rest) in enumerate(rows)]
    kept = Counter(r.text for r in cp.near_dedup(spark, frame(spark, bare), SF).collect())
    classes = {}
    for (_, text, *_), c, n in zip(rows, label, sizes):
        if n:
            classes.setdefault(c, []).append(text)
    assert sum(len(t) > 1 for c, t in classes.items() if c % 2) > 1  # near copies without any doc_id
    assert all(sum(kept[t] for t in set(texts)) == 1 for texts in classes.values())


def test_run(spark):
    found = cp.run(spark, SF).collect()
    ids = {r.doc_id for r in found}
    assert found and len(ids) > 100 and Counter(r.doc_id for r in found).most_common(1)[0][1] <= 2


def test_stages_of_the_contract():
    assert [n for n, _ in cp.STAGES] == ["language", "exact_dedup", "near_dedup", "mix", "encode"]


def test_no_name_of_a_column_clashes(spark):
    names = ["doc", "cuts", "Row", "__id", "__mark", "__group", "LANG_PRED", "Kept", "at"]
    rows = [(i, "some words of text %d" % (i // 2), "en", "s", 9) + tuple(f"{n}{i}" for n in names) for i in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in cp.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns, name
        assert found.count() and all(r[n] == f"{n}{r.doc_id}" for r in found.collect() for n in names), name


def test_unlabelled_corpus_is_kept(spark, messy):
    from pyspark.sql import functions as F

    kept = cp.language(spark, messy.withColumn("lang", F.lit(None).cast("string")), SF).collect()
    assert len(kept) == sum(any(c.isalpha() for c in text or "") for _, text, *_ in MESSY)


def test_choice_among_equal_ids_does_not_depend_on_the_order(spark):
    rows = [(1, "A b c d e f", lang, f"s{i}") for i, lang in enumerate(["en", "de", None, "fr"])]
    first = cp.exact_dedup(spark, frame(spark, rows).repartition(1), SF).collect()
    assert len(first) == 1 and first == cp.exact_dedup(spark, frame(spark, rows[::-1]).repartition(3), SF).collect()
