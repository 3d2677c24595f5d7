import pytest

from tests.oracle import session


@pytest.fixture(scope="session")
def spark():
    spark = session()
    from castloom.session import tune

    yield tune(spark)
    spark.stop()
