import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from storylens.session import get_session

    s = get_session(master="local[4]", shuffle_partitions=4, app_name="storylens-tests")
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
