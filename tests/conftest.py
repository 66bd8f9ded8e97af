import pytest

from pagewright.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, app="tests")
    yield s
    s.stop()
