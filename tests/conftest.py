import pytest

from quillgrid.session import build_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    ship_package(session)
    yield session
    session.stop()
