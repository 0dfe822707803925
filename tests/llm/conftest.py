import pytest

#: Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results.
ODD = [
    (1, "the cat sat on the mat and looked at the moon tonight", "en", "a"), (2, "", "en", "a"), (3, None, "en", None), (4, "the cat sat on the mat and looked at the moon tonight", "en", "b"), (4, "the cat sat on the mat and looked at the moon tonight", "en", "b"),
    (5, "word " * 4000, "en", "b"), (6, " \n\t ", None, ""), (None, "no id here but some words in the text of it all", "en", "a"), (7, "é ü x y\r\nz <|endoftext|> 'tis\x00", "fr", "c"), (8, "ONE two THREE", "en", "c"), (9, "one TWO three", "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, 1, "s", True, 2.0, 3) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, kept boolean, size double, component_id int").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
