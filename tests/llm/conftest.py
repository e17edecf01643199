import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
#: Columns of other tables' and the operators' own names, which mustn't matter.
CLASHING = ("n", "h", "key", "old", "sha", "rep", "score", "spans", "component_id", "grams", "label", "t")

LONG = "lorem " * 30_000
NASTY = [
    (1, None), (2, ""), (3, " \n\t\x0b"), (4, "one"), (5, "Alpha beta gamma delta epsilon"), (6, "alpha BETA gamma delta epsilon"),
    (7, "x" * 200_000), (8, LONG), (9, "twice the same row here ok"), (9, "twice the same row here ok"), (10, "Grüße 日本語 \U0001f600 naïve"),
    (None, "a row without an id but with words"), (11, "alpha beta gamma delta epsilon"), (12, "!!! ??? ..."), (13, "İſK 'S don't"),
]


def table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(1) for c in CLASHING}) if extra else df


@pytest.fixture(scope="session")
def nasty(spark):
    return table(spark, NASTY)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF
