import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from retainspark.session import build_session  # noqa: E402

SF = {"0.001": "/root/testdata/sf0.001", "0.01": "/root/testdata/sf0.01"}


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SF["0.001"]
