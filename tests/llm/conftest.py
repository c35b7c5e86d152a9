import pytest


@pytest.fixture
def table(spark, tmp_path):
    """A function that writes rows as one table of a folder and gives the folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


#: Nulls, empty and blank texts, ties, repeated rows, a very long text, and columns whose names clash with results.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", 5),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", 5),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", 6),
    (3, None, None, None),
    (4, "", "en", 1),
    (5, " \n\t ", "fr", 1),
    (None, "no id here, mail a.b@example.com or +1 (555) 555-0100", "en", 2),
    (7, "très élégant où ça été garçon " * 4000, "fr", 2),
    (8, "x" * 30000, None, 3),
    (9, "1234 !!! 5678", "en", 3),
    (11, "card 4111 1111 1111 1111 at 10.0.0.255", "en", None),
]
ODD_SCHEMA = "doc_id long, text string, lang string, score int"


@pytest.fixture
def odd(table):
    return table("documents", ODD, ODD_SCHEMA)


@pytest.fixture
def empty(table):
    return table("documents", [], ODD_SCHEMA)
