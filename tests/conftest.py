import pytest

from arcwright.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(4, "tests", spark__sql__shuffle__partitions="4", spark__default__parallelism="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
