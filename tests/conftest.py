import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from catchment.session import local_session

    ckpt = tempfile.mkdtemp(prefix="catchment-test-ckpt-")
    s = local_session(
        "*",
        app="catchment-tests",
        **{"spark.sql.shuffle.partitions": "8", "spark.checkpoint.dir": ckpt, "spark.driver.memory": "8g"},
    )
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL


@pytest.fixture(scope="session")
def sf_mid():
    return SF_MID
