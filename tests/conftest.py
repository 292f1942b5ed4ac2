import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tracegrain.session import build_session

    session = build_session("tests", "local[8]", 2)
    session.sparkContext.setLogLevel("OFF")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture
def small_chunks(spark):
    """Split groups above a handful of rows, so ordered scans take the distributed path."""
    from tracegrain.session import ROWS_PER_CHUNK_KEY

    spark.conf.set(ROWS_PER_CHUNK_KEY, "5")
    yield
    spark.conf.unset(ROWS_PER_CHUNK_KEY)
