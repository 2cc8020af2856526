import os

import pytest

from kithmark.runtime import get_session

DATA = os.environ.get("KITHMARK_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    d = f"{DATA}/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data here")
    return d
