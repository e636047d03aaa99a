import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paths import SF  # noqa: E402

from quayside.session import local_session  # noqa: E402
from quayside.sources.tables import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SF)


@pytest.fixture(scope="session")
def evaluate(spark):
    """Apply a column function to each of some values and return the results."""
    from pyspark.sql import functions as F

    def run(function, values, type_="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
        rows = df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
        return [r["r"] for r in rows]

    return run
