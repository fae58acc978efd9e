import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tracecast.ship import ship  # noqa: E402

#: Fixed value: the complete small log that the expected trees, lines and statistics belong to; 64 cases by id, their activities.
SMALL_LOG = (
    "1-0-2;7;6;6;7;0-1-2;6;6;3-4;3-4;3-4;3-4-5-3-4-5-3-4;7;6;7;7;1-0-2;0-1-2;1-0-2;3-4-5-3-4;6;3-4-5-3-4;"
    "3-4-5-3-4-5-3-4;1-2-0;1-0-2;7;6;0-1-2;3-4;7;1-0-2;6;6;1-0-2;6;7;0-1-2;6;6;6;7;3-4;7;7;3-4;1-2-0;6;7;"
    "1-2-0;6;6;3-4;0-1-2;6;7;7;7;7;3-4;7;7;6;0-1-2;1-0-2"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)


@pytest.fixture(scope="session")
def trace_frame(spark):
    def build(text: str):
        rows = [(i, t.split("-")) for i, t in enumerate(text.split(";"))]
        return spark.createDataFrame(rows, "case_id bigint, acts array<string>")

    return build


@pytest.fixture(scope="session")
def small(trace_frame):
    return trace_frame(SMALL_LOG)
