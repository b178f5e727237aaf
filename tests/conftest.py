import pytest

from tablemill.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of tuples, nulls allowed."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
