import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SF = os.environ.get("PLUMBLINE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import get_spark

    return get_spark("tests", shuffle=4)


@pytest.fixture(scope="session")
def con():
    from harness import connect

    return connect(SF)


@pytest.fixture(scope="session")
def sf():
    return SF
