"""Tables for the text operators' tests."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table of (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


PROSE = "the quick brown fox jumps over the lazy dog while a small bird sings in the old oak tree near the river bank and people walk along the path every morning before work begins again".split()


def prose(seed, n=80):
    """Words that differ with the seed."""
    import random

    r = random.Random(seed)
    return " ".join(r.choice(PROSE) + r.choice(["", "s", "ed", "ing"]) for _ in range(n)) + "."


#: Rows that no operator may stumble over: null columns, empty and long texts, ties, repeats.
ODD = [
    (1, prose(1)), (1, prose(1)), (2, None), (3, ""), (4, "word"), (5, " \n\t \n"), (None, prose(2)), (None, None), (6, prose(1)), (7, prose(3), None, None), (7, prose(4), "", ""), (8, "line\n" * 5000), (9, "x" * 200_000),
    (10, "é\U0001f600 漢字 \x00\x1c\x85  á"), (11, prose(5, 30_000)), (12, "1 2 3 " * 3000), (13, "a@b.c " * 500), (2**62, prose(6)), (-5, prose(7)),
]
