import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pagemark.session import local_session, remove_tables
    s = local_session(cores="*", shuffle_partitions=8, app="pagemark-tests")
    yield s
    remove_tables(s)
    s.stop()
