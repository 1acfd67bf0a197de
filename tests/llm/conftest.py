import pytest


@pytest.fixture
def rows(spark):
    """Make a DataFrame of rows over a schema, in three partitions."""
    def make(data, schema):
        return spark.createDataFrame(data, schema).repartition(3)
    return make
