import pytest

from creditloom.llm.blocks import prepare

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def documents(llm, folder):
    return llm.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def odd(llm):
    """Nulls in every column, empty, blank and long texts, repeated rows and names that operators add themselves."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, passage + " one", "en", "a", 1, 5, "x"), (2, "start " + passage, "en", "a", 1, 5, "x"), (2, "start " + passage, "en", "a", 1, 5, "x"),
        (3, None, None, None, None, None, None), (4, "", "en", None, 1, 5, "x"), (5, " \t\n ", "fr", "a", 1, 5, "x"),
        (None, passage, "en", "a", 1, 5, "x"), (None, "unlike the others", None, "a", None, 5, "x"), (6, "7 8 9 ## --", "de", "b", 1, 5, "x"),
        (7, "é" * 3000 + " Straße " + "abc def " * 4000, "de", "b", 1, 5, "x"), (8, "a b a b a b a b a b a b", "en", "b", 1, 5, "x"),
        (9, "mail a.b@c.org or +49 (30) 1234-5678 at 10.0.0.1 \U0001F600 card 4111 1111 1111 1111", "en", "b", 1, 5, "x"),
    ]
    return llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, score string")


@pytest.fixture(scope="session")
def nothing(llm):
    return llm.createDataFrame([], DOC_SCHEMA)
