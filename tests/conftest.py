import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventlab.session import local_session  # noqa: E402

DATA = os.environ.get("EVENTLAB_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
