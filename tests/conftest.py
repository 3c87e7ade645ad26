import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from crossweave.session import local_session  # noqa: E402
from tests.frames import series_frame, to_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s


@pytest.fixture(scope="session")
def bars_pdf():
    return series_frame()


@pytest.fixture(scope="session")
def bars(spark, bars_pdf):
    return to_spark(spark, bars_pdf)
