import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row long, size int, node string, kept string, "
    "block int, digest string, held_out string, length string, spans string, word string, rejected string, `group` string, no int"
)
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
BODY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"

#: NULLs in every column, empty and very long texts, ties, repeated rows, rows without a doc_id.
MESSY = [
    (1, BODY, "en", "s1"),
    (2, BODY.upper(), "en", "s1"),
    (3, BODY + " phi", "en", None),
    (4, None, "en", "s2"),
    (5, "", None, "s2"),
    (6, " \t\n", "en", "s1"),
    (7, "one two", "de", "s3"),
    (8, "one two", "de", "s3"),
    (9, LONG, "en", "s1"),
    (9, LONG, "en", "s1"),
    (10, "#!? 12 %%", "fr", "s1"),
    (11, "Éè ça ñ ß 中文 😀 \x00 é", "fr", "s1"),
    (None, BODY, None, None),
    (None, "zwei drei vier", "de", "s3"),
    (12, "one two", None, "s2"),
    (12, "other words here", "en", "s2"),
]


def frame(spark, rows):
    """``documents`` with further columns whose names the operators use themselves."""
    extra = (7, 1, "n", "k", 2, "d", "h", "l", "s", "w", "r", "g", 3)
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *extra) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def messy(spark):
    return frame(spark, MESSY).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])
