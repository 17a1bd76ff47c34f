import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and extra columns with the operators' own names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 10),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 10),
        (2, None, None, None, None),
        (None, "a null id with some words in its text", "en", "b", 5),
        (None, None, None, "b", None),
        (3, "", "en", None, 0),
        (4, " \n\t ", "en", "c", 4),
        (5, LONG, "en", "c", len(LONG)),
        (6, "one", "en", "c", 3),
        (7, "ünïcode ² ½ text 信息系统 \x1c sep <|endoftext|> end", "de", "ß", 9),
        (7, "other text of the same id, it is", "de", "ß", 9),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = ("row", "size", "shard", "slot", "score", "copies", "component_id", "fp", "new_text", "_text", "_key", "start", "ids", "target", "kept")
    return docs.withColumns({n: F.lit(7) for n in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
