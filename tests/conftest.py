import pytest

from planlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cpus=4, shuffle_partitions=4)
