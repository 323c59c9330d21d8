import pytest

from whinstone.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
