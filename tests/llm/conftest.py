import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows, schema): a small table."""
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make
