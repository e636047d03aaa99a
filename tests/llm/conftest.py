import pytest
from helpers import clashing, prose

from quayside.llm.common import Store


@pytest.fixture
def store(spark):
    return Store(spark, "test")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank and very long texts, repeated rows, ties, rows without an id, a lone odd byte."""
    long = prose(5, 60_000)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one two"), (7, long), (8, long + " more"), (9, prose(9, 80)),
        (9, prose(9, 80)), (10, prose(10, 90)), (10, prose(11, 70)), (None, prose(9, 80)), (None, None), (12, "a" * 50_000), (13, "ÀÉ 日本語 <|endoftext|> ＡＢ"),
    ]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
