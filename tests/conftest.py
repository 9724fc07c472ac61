import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from strandlake.session import local_session, ship

    session = local_session("tests", "4", 4)
    session.sparkContext.setLogLevel("OFF")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
