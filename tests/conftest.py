import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quizspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = build_session("local[8]", 8, {"spark.driver.memory": "8g", "spark.checkpoint.dir": shared})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column expression over literal rows of one text column ``x``."""
    def run(items, make):
        rows = [(i, x) for i, x in enumerate(items)]
        df = spark.createDataFrame(rows, "i int, x string")
        from pyspark.sql import functions as F
        return [r[1] for r in sorted(df.select("i", make(F.col("x")).alias("y")).collect())]
    return run
