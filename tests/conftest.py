import pytest

from tidemark import session


@pytest.fixture(scope="session")
def spark():
    found = session.build("tests", cores="8", partitions=4)
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
