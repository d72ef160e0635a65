import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id bigint, text string"

#: Nulls, empty and blank texts, ties, repeated rows and a long text.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "same text here"), (6, "same text here"), (7, "other text"), (7, "third text"),
         (None, "no id"), (None, None), (8, "word " * 30_000), (9, "x" * 50_000), (10, "\u0000 control ﻿ \U0001f600 é")]


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows with extra columns that clash with names the operators use."""
    from pyspark.sql import functions as F
    extra = ["words", "doc", "mark", "n", "score", "ids", "hash", "start", "fp", "label", "key", "n_chars", "id", "r"]
    return spark.createDataFrame(EDGES, DOCS).repartition(3).withColumns({c: F.lit(c) for c in extra})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS + ", words string, n int")
