import pytest

from tenderspark.llm.tokens import vocabulary


@pytest.fixture(scope="session")
def path():
    return vocabulary("byte_bpe_50k.json")


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty, repeated and long texts, and columns that clash with those of the operators."""
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "one two three four five six\nsame line in both of them", "a"), (2, None, None), (3, "", "a"), (4, words, "b"), (5, words, "b"),
            (5, words, "b"), (None, words, "b"), (6, "x" * 9000, "b"), (7, "a  b \n\n cé <|endoftext|> \U0001f600 ", "c"),
            (8, "something else here\nSame  line in both of them", "c"), (9, words.replace("w30 ", "changed "), "a"), (10, "short", "a")]
    rows = [(*r, 1, 2, 3, "x", "y", 4.0) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id int, line int, grp int, component string, position string, weight double")
