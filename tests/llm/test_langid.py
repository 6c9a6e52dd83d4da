import zlib

import numpy as np

from voxelfield.llm import langid
from tests.llm.conftest import MESSY, frame

SF = "/root/testdata/sf0.01"


def test_counts_by_hand():
    row, letters = langid.counts("Ab, ab")
    # Four letters; grams of " ab ab ": 4 of one letter, 6 of two, 5 of three characters.
    assert letters == 4 and row.sum() == 15
    assert langid.counts(None)[1] == 0 == langid.counts("12 #")[1]
    assert np.array_equal(langid.counts("AB-ab")[0], langid.counts("ab   ab")[0])


def test_clusters_part_what_is_apart():
    rng = np.random.default_rng(0)
    axes = np.eye(3, 40)
    rows = np.vstack([a + 0.05 * rng.random((30, 40)) for a in axes]).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    means = langid.spherical_means(rows, 3)
    own = (rows @ means.T).argmax(axis=1).reshape(3, 30)
    assert all(len(set(o)) == 1 for o in own) and len({o[0] for o in own}) == 3
    assert len(langid.spherical_means(rows[:1], 4)) == 1


def test_document_frequencies_cover_all_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(100)
    texts = [r.text for r in docs.select("text").collect()]
    wanted = sum((langid.counts(t)[0] > 0).astype(int) for t in texts)
    found, n = langid.document_frequencies(docs.repartition(5))
    assert n == len(texts) and np.array_equal(found, wanted)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    found = langid.identify(docs).collect()
    assert sorted(r.doc_id for r in found) == sorted(truth)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) >= 0.98 * len(held)
    assert not any(r.rejected for r in found if len(truth[r.doc_id][1]) > 200)


def test_only_the_text_decides_and_strange_text_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    strange = "Ωμέγα και άλφα είναι γράμματα του αλφαβήτου και δεν είναι εδώ γνωστά"
    rows = frame(spark, [(1, "the and of that with", "fr", "x"), (99, "the and of that with", None, None), (2, strange, "en", "s"), (3, "…", "en", "s"), (4, None, "en", "s")])
    found = {r.doc_id: r for r in langid.predict(rows, model, ["doc_id"]).collect()}
    assert found[1].lang_pred == found[99].lang_pred == "en" and found[1].score == found[99].score
    assert found[2].rejected and not found[1].rejected
    assert found[3].lang_pred == found[4].lang_pred == "und" and found[3].score == 0 and found[4].rejected


def test_messy(messy, empty):
    found = langid.identify(messy).collect()
    assert len(found) == len(MESSY)
    assert all(r.lang_pred == "und" for r in found if r.doc_id in (4, 5, 6, 10))
    assert langid.identify(empty).collect() == []


def test_no_label_rejects_letterless_texts_only(spark, messy):
    from pyspark.sql import functions as F

    unlabelled = messy.withColumn("lang", F.lit(None).cast("string"))
    model = langid.fit(unlabelled)
    assert model.labels == []
    found = langid.predict(unlabelled, model, ["doc_id", "text"]).collect()
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, not letters)


def test_labels_are_learned_without_ids_and_above_the_bound(spark):
    """Rows without a doc_id are sampled by their text: no label is lost, none is taken whole."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.lit(None).cast("long"))
    labels = {r.lang for r in docs.where("lang is not null").select("lang").distinct().collect()}
    for bound in (20, 60):
        assert set(langid.fit(docs, sample_rows=bound).labels) == labels


def test_prediction_against_plain_cosines(spark):
    """Every prediction is the centroid of the greatest cosine, one text at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    model = langid.fit(docs)
    for r in langid.predict(docs, model, ["text"]).collect():
        raw, letters = langid.counts(r.text)
        if not letters:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        row, _ = langid.vectors([r.text], model.idf)
        cosines = [float(row[0] @ c) for c in model.centroids]
        best = max(cosines)
        close = [lang for lang, c in zip(model.labels, cosines) if best - c < 1e-5]
        assert r.lang_pred in close and abs(r.score - best) < 1e-4
        assert abs(float((row[0] ** 2).sum()) - 1) < 1e-3
