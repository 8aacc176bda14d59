import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pulsegrid.session import local_session

    return local_session("4", shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def con():
    from verify import views

    return views(SMALL)
