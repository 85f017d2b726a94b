import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, h string, th string, size string, shard string, row__ string, bucket string, key__ string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and extra columns whose names operators use inside."""
    base = "the quick brown fox jumps over the lazy dog and runs through the wide green forest until night"
    extra = ("x",) * 9
    rows = [
        (1, base, "en", "a", 1),
        (1, base, "en", "a", 1),
        (2, base, "en", "b", 1),
        (3, None, "en", "a", None),
        (None, base + " again", None, None, None),
        (None, None, None, None, None),
        (4, "", "en", "", 0),
        (5, "  \n\t ", "en", "b", 5),
        (6, "word " * 60_000, "en", "a", 300_000),
        (7, "x" * 200_000, "en", "a", 200_000),
        (8, "Ünïcödé — 数字 ١٢٣ \U0001f600 mail me: a@b.example.com, +1 (603) 555-8791, 4111 1111 1111 1111, 10.0.0.255", "de", "c", 9),
        (9, "!!! ??? ...", "en", "b", 9),
        (10, base.replace("fox", "wolf"), "en", "b", 1),
    ]
    return spark.createDataFrame([r + extra for r in rows], ODD)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD)
