import pytest

from tests.compare import duck
from tests.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def con():
    """A connection of its own for each test: an error in one leaves the others alone."""
    with duck(SMALL) as own:
        yield own


@pytest.fixture
def pieces(spark):
    """Keep small shuffles apart, so that results pass through several tasks."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield 8
    spark.conf.set(key, before)
