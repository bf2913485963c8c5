import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def frame(spark):
    """A table from rows and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
