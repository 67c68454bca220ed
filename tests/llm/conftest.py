import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, ids array<int>"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and wordless texts, ties, repeated rows, a very long text, extra columns."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 40, 40, 400)]
    rows = [
        (1, texts[3], "en", "a", 1, "x", [1]),
        (1, texts[3], "en", "a", 1, "x", [1]),
        (2, texts[3], "fr", None, None, None, None),
        (None, texts[4], None, "b", 2, "y", []),
        (None, None, None, None, None, None, None),
        (3, None, "en", "a", 0, "", [2]),
        (4, "", "en", "b", 0, "", [2]),
        (5, " \t\n", "en", "b", 3, "", [2]),
        (6, "!!! 123 $$$", None, "b", 3, "", [2]),
        (7, texts[0], "fr", "c", 3, "", [2]),
        (8, texts[1], "fr", "c", 3, "", [2]),
        (9, texts[2] + "  x\n\n y 日本語 🙂 \x01", "fr", "c", 3, "", [2]),
        (10, " ".join(word() for _ in range(60_000)), "en", "c", 3, "", [2]),
        (11, texts[5], "en", "a", 3, "", [2]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
