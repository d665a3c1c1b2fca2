import pytest

from tests.llm.brute import BASE, made_texts


@pytest.fixture(scope="session")
def corpus():
    return list(enumerate(made_texts()))


@pytest.fixture(scope="session")
def frame(spark, corpus):
    """The corpus with columns whose names clash with results."""
    rows = [(i, t, "en" if i % 3 else None, None if i % 11 == 0 else f"s{i % 4}", i, i, True, "z", 0.5) for i, t in corpus]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, key string, score double"
    return spark.createDataFrame(rows, kinds).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and repeated rows."""
    text = " ".join(BASE * 4)
    rows = [(None, text, "en", "a", 1), (None, None, None, None, None), (5, text, "en", "a", 1), (5, text, "en", "a", 1), (6, "", "en", None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
