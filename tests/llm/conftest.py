"""Edge documents that every corpus operator has to take."""

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       *[T.StructField(c, T.StringType()) for c in ("size", "h", "__id", "__th", "t", "i", "x", "kept", "label", "copies", "n_lines", "words", "row")]])
PROSE = "the river runs past the old mill and under seven stone bridges before it meets the sea near a small harbour town"
LONG = " ".join(f"word{i % 5003}" for i in range(60_000))


def rows():
    texts = [(0, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE + " again", "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \n\t ", "de", None), (None, PROSE, "en", "a"),
             (None, None, None, None), (6, LONG, "en", "c"), (7, "x" * 100_000, "en", "c"), (8, PROSE, "en", "a"), (8, PROSE, "en", "a"), (9, "one two three", "fr", "b"), (10, "a\nb\nc\na\nb", "en", "b"),
             (11, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" and joe.19@mail5.example.com or 10.20.30.40", "en", "a")]
    return [(d, t, la, s, None if t is None else len(t), *["z"] * 13) for d, t, la, s in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
