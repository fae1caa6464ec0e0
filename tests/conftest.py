import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from callsift.session import get_spark, shared_dir
    s = get_spark("local[4]", shuffle_partitions=8)
    shared_dir(s)
    yield s
    s.stop()
