import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tickfold-tests")
        .config("spark.sql.shuffle.partitions", "2")
        # Call sites of every column expression are not needed here.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_points(spark):
    """Points numbered in order, spread over a few partitions."""

    def make(rows, first_id=0, parts=3):
        table = [(first_id + i, [float(v) for v in x]) for i, x in enumerate(rows)]
        return spark.createDataFrame(table, "point_id bigint, x array<double>").repartition(parts)

    return make
