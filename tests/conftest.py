import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from strata.session import get_session
    ckpt = tempfile.mkdtemp(prefix="strata-test-ckpt-", dir="/tmp")
    s = get_session("local[*]", app="strata-tests", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "8g"})
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
