import pytest

DOCS = "doc_id long, text string, lang string, _id string, score string"


@pytest.fixture(scope="session")
def docs(spark):
    """Hand-made documents: nulls, blanks, ties, repeated rows, long texts, and columns with clashing names."""
    long = " ".join(f"word{i % 97} and{i % 13}" for i in range(4000))
    rows = [
        (1, "The cat sat on the mat.", "en", "a", "b"),
        (2, "The  cat sat\ton the mat.", "en", None, None),
        (3, "the cat sat on the mat.", None, "x", "y"),
        (4, None, "en", "a", "b"),
        (5, "", None, None, None),
        (6, " \n\t ", "fr", "q", "q"),
        (7, long, "en", "l", "l"),
        (8, long + " tail", "en", "l", "l"),
        (9, "caf\u00e9 na\u00efve \u4e2d\u6587 \U0001f600 <|endoftext|> e\u0301", "fr", "u", "u"),
        (10, "It's don't 'tis \u00c9T\u00c9 STRASSE \u03a3\u0391\u03a3", "de", "u", "u"),
        (11, "one", "en", "s", "s"),
        (1, "The cat sat on the mat.", "en", "a", "b"),
        (None, "no id", "en", "n", "n"),
        (None, "no id", "en", "n", "n"),
        (12, "The cat sat on the mat.", "en", "z", "z"),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
