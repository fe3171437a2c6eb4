import pytest

from seqloom.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 8)
    ship_package(s)
    yield s
    s.stop()
