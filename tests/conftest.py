import os

import pytest

from rawloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(int(os.environ.get("TEST_CPUS", "8")), 8, "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
