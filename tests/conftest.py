import pytest

from gridloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores="4", shuffle_partitions=4)


@pytest.fixture
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make
