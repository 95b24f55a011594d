import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from palisade import build_session  # noqa: E402

DATA = os.environ.get("PALISADE_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[8]", "palisade-tests", **{
        "spark_sql_shuffle_partitions": "8", "spark_driver_memory": "8g",
        "spark_checkpoint_dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return os.path.join(DATA, "sf0.001")


@pytest.fixture(scope="session")
def medium():
    return os.path.join(DATA, "sf0.01")
