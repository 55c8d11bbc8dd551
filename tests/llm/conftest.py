import pytest

from llm import made


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with every odd case: nulls, empty and long texts, ties, repeats, clashing columns."""
    return spark.createDataFrame(made.documents(), made.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], made.SCHEMA)
