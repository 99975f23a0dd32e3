import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, gone string, copy int, id string, `rank` int, sig string, pos long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text[, source]) as a table with further columns, whose names operators also use."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 1, "k", "g", 7, "i", 3, "x", 5) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, short, repeated, very long, and non-ASCII texts; null and repeated ids."""
    long = " ".join(f"w{k * 7919 % 5003}" for k in range(60_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d"), (6, "a b c d"), (None, "null id text that has more than five words"), (None, None),
        (7, "Żółć größe naïve 漢字 \U0001f600 and more words here"), (7, "Żółć größe naïve 漢字 \U0001f600 and more words here"), (8, long), (9, long + " tail"), (10, "x" * 300_000), (11, "é" * 700), (12, "\x1c\x85\xa0 a\x0bb\x0cc"),
    ]
