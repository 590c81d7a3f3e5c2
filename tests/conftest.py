import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from waylattice.session import build_session, ship_package

    s = build_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    return s
