import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for p in (ROOT, os.path.join(ROOT, "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)

TESTDATA = os.environ.get("PADDOCK_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from paddock.session import local_session

    s = local_session(shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return os.path.join(TESTDATA, "sf0.001")


@pytest.fixture(scope="session")
def sf_check():
    return os.path.join(TESTDATA, os.environ.get("PADDOCK_CHECK_SF", "sf0.01"))
