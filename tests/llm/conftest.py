import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FIELDS = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
          T.StructField("key", T.StringType()), T.StructField("tag", T.LongType()), T.StructField("n_words", T.StringType())]  # the last three clash with inner names


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) or (doc_id, text, source), with further columns whose names the operators use themselves."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "k", 1, "n") for r in rows]
        return spark.createDataFrame(full, T.StructType(FIELDS)).repartition(parts) if full else spark.createDataFrame([], T.StructType(FIELDS))

    return make


@pytest.fixture(scope="session")
def small():
    """Texts with copies, near copies, shared passages, ties, blanks and one very long text."""
    words = [f"w{i * 7919 % 997}" for i in range(400)]
    base = [" ".join(words[i:i + 40]) + "\n" + " ".join(words[i + 40:i + 90]) for i in range(0, 300, 30)]
    rows = list(enumerate(base))
    rows += [(50, base[0]), (51, base[0]), (52, base[1].replace("w1", "W1")), (53, "x y " + base[2] + " z"), (54, base[3].replace(" ", "  ", 3))]
    rows += [(60, None), (61, ""), (62, " \n\t\n "), (63, "One"), (64, "one"), (65, "a b"), (66, "A  b"), (67, "été 日本 \U0001f600 " * 9)]
    rows += [(70, " ".join(words * 40)), (None, base[4]), (None, None), (71, base[5]), (71, base[5]), (71, base[6])]
    return rows
