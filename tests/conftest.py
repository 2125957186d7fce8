from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfmark.session import session  # noqa: E402

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = session(
        "tests",
        "local[*]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark, *documents):
    """A normalised catalog of JSON texts, in order."""
    from pyspark.sql import functions as F

    from shelfmark import normalize

    rows = spark.createDataFrame(list(enumerate(documents)), "pos long, doc string")
    return normalize(rows.select("pos", F.parse_json("doc").alias("raw")))
