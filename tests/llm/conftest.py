import pytest

#: Nulls in any column, empty, blank and long texts, ties, repeated rows, and columns whose names operators use inside.
ROWS = [
    (1, "The same text, twice.", "en", "src1"),
    (2, "the SAME text, twice.", "en", "src2"),
    (2, "the SAME text, twice.", "en", "src2"),
    (3, None, "en", None),
    (4, "", None, "src1"),
    (5, " \n\t ", "fr", "src1"),
    (None, "a row without an id", "de", "src3"),
    (None, None, None, None),
    (7, "word " * 40_000, "en", "src4"),
    (8, "é è ü 漢字 😀 " * 30, "fr", "src4"),
    (9, "one", "en", "src5"),
    (10, "x" * 70_000, "en", "src5"),
    (11, "A line of more than one hundred bytes that several documents share, so that later copies of it can go away.", "en", "src6"),
    (12, "Before it. A line of more than one hundred bytes that several documents share, so that later copies of it can go away.", "en", "src7"),
]
NAMES = "id long, row int, part string, fp string, rank double, block long, kind int, length string, hash int, text2 string"


@pytest.fixture(scope="session")
def odd(spark):
    """ROWS with clashing columns beside."""
    rows = [(i, t, lang, source, len(t or ""), i, 0, "p", "f", 1.0, 3, 1, "l", 9, t) for i, t, lang, source in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + NAMES).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id = -1")


@pytest.fixture(scope="session")
def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
