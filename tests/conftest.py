import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from roadlens.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4, app_name="roadlens-tests")
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from compare import duck
    return duck(SMALL)
