import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from plurality.session import local_session

    s = local_session("*", shuffle_partitions=8, app="plurality-tests")
    yield s
    from plurality.session import clean_scratch

    clean_scratch(s)
    s.stop()
