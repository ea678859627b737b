import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from millrace.operators.ordering import SPLIT_ROWS_KEY  # noqa: E402
from millrace.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8, 4)
    yield session
    session.stop()


@pytest.fixture(params=[4_000_000, 7], ids=["one-bucket", "split"])
def buckets(request, spark):
    """Run a test with whole frames in one bucket, and again with a few rows per bucket."""
    spark.conf.set(SPLIT_ROWS_KEY, request.param)
    yield request.param
    spark.conf.unset(SPLIT_ROWS_KEY)


@pytest.fixture
def sf():
    return SF
