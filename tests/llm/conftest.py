import pytest

LONG = " ".join(f"word{i % 700}x{i % 13}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", "first"),
    (2, "alpha beta gamma delta epsilon zeta", "en", "a", "copy"),
    (3, None, "en", "a", "null text"),
    (4, "", None, "a", "empty"),
    (5, "   \t\n ", "fr", None, "blank"),
    (6, LONG, "en", "a", "long"),
    (7, LONG + " tail", "en", "b", "long, nearly equal"),
    (8, "Ünïcode ▁ text 12 <s> </s> [INST] \\ <\\s> 日本", None, "b", "odd letters"),
    (None, "a row without an identifier of its own", "en", "a", None),
    (9, "two words", "de", "c", "short"),
    (9, "two words", "de", "c", "short"),
    (10, "%%% ### 123 $$$", None, "c", "no letter"),
    (11, "x@y.example.com +1 (456) 555-2186 and 10.0.0.1 and 4111 1111 1111 1111", "en", "a", "personal"),
]
SCHEMA = "doc_id long, text string, lang string, source string, row string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and an extra column named like an inner one."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.01"
