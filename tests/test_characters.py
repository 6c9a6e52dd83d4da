import pytest

from voxelfield.operators import characters, evaluate


@pytest.fixture(scope="module")
def flashes(spark):
    """Character 1 decodes right from its second sequence on, 2 ties, 3 never matches."""
    rows = []
    for char, target in ((1, (2, 10)), (2, (1, 7)), (3, (3, 9))):
        for n in range(24):
            code = n % 12 + 1
            hit = code in target
            score = {1: 5.0 if hit and n >= 12 else (2.0 if code in (4, 8) and n < 12 else 0.0),
                     2: 1.0 if code in (1, 7, 6) else 0.0, 3: 3.0 if code in (4, 8) else 0.0}[char]
            rows.append((char, 100 * char + n, code, int(hit), score, -score))
    return spark.createDataFrame(rows, "char_id long, seq_no long, code int, is_true int, score double, other double").repartition(5)


def test_truth_and_prediction_strings(flashes):
    truth = {r.char_id: r.truth for r in characters.true_characters(flashes).collect()}
    assert truth == {1: "2-10", 2: "1-7", 3: "3-9"}
    predicted = characters.predicted_characters(characters.code_scores(flashes))
    assert {r.char_id: r.predict for r in predicted.collect()} == {1: "2-10", 2: "1-6-7", 3: "4-8"}


def test_first_sequences_in_order(flashes, monkeypatch):
    got = characters.first_k_sequences(flashes, 1)
    assert got.count() == 36 and got.where("seq_no % 100 >= 12").count() == 0
    monkeypatch.setattr(characters, "GROUP_LIMIT", 5)
    ranged = characters.first_k_sequences(flashes, 1)
    assert sorted(map(tuple, ranged.collect())) == sorted(map(tuple, got.collect()))
    monkeypatch.undo()
    monkeypatch.setattr(characters, "HOT_ROWS", 0)
    salted = characters.first_k_sequences(flashes, 1)
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, got.collect()))


def test_accuracy_and_curve_agree(flashes):
    assert characters.character_accuracy(flashes, 1).first()[0] == pytest.approx(0.0)
    assert characters.character_accuracy(flashes, 2).first()[0] == pytest.approx(1 / 3)
    curve = characters.character_accuracy_curve(flashes, [1, 2, 3], {"score": "score", "other": "other"})
    got = {(r.k, r.method): r.accuracy for r in curve.collect()}
    assert len(got) == 6
    assert got[(1, "score")] == 0.0 and got[(2, "score")] == got[(3, "score")] == pytest.approx(1 / 3)


def test_truth_without_prediction_counts_as_wrong(spark, flashes):
    late = spark.createDataFrame([(1, 1)], "subject_id long, pred int")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "subject_id long, y int")
    assert evaluate.accuracy(late, labels).first()[0] == 0.5
    methods = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("b", 1, 1)], "method string, subject_id long, pred int")
    assert {tuple(r) for r in evaluate.accuracy(methods, labels, ["method"]).collect()} == {("a", 1.0), ("b", 0.5)}


def test_confusion_summary(spark):
    pairs = [(0, 0)] * 4 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)]
    labels = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs)], "subject_id long, y int")
    pred = spark.createDataFrame([(i, p) for i, (_, p) in enumerate(pairs)], "subject_id long, pred int")
    matrix = evaluate.confusion_matrix(pred, labels)
    assert sorted(map(tuple, matrix.collect())) == [(0, 4, 2), (1, 1, 3)]
    row = evaluate.confusion_summary(matrix).first()
    assert row.accuracy == pytest.approx(0.7) and row.sensitivity == pytest.approx(4 / 6) and row.specificity == pytest.approx(3 / 4)
    assert row.kappa == pytest.approx((0.7 - 0.5) / 0.5)
