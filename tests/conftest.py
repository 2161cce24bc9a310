import pytest

from linkloom.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
    yield s
    s.stop()
