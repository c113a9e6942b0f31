import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows, schema): a DataFrame in more than one partition."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame(rows, schema)
