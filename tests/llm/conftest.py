import pytest


@pytest.fixture(scope="session")
def fresh(spark, tmp_path_factory):
    """A function that writes rows as the tables of a folder, as queries read them."""

    def make(**tables):
        root = tmp_path_factory.mktemp("tables")
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(str(root / f"{name}.parquet"))
        return str(root)

    return make


#: Nulls in every column, empty, blank, tiny and repeated texts, a clash of names.
ODD = [
    (1, "The cat sat on the mat and looked at the dog.", "en", "a", 10, "x", 0.5),
    (1, "The cat sat on the mat and looked at the dog.", "en", "a", 10, "x", 0.5),
    (2, None, "en", "a", None, None, None),
    (3, "", None, None, 0, "y", None),
    (4, " \n\t ", "en", "b", 4, "y", 0.1),
    (None, "The cat sat on the mat and looked at the dog.", "en", "b", 5, "y", 0.1),
    (5, "x", "de", None, 1, None, None),
    (6, "12345 !!!", "de", "b", 9, None, None),
    (7, "der hund und die katze " * 4000, "de", "b", 9, None, None),
    (8, "é😀 secret=token:abcdef12", "de", "b", 9, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
