import pytest

from factloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, partitions=8, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
