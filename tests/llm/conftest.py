import pytest

from tests.llm import samples


@pytest.fixture(scope="session")
def awkward(spark):
    return samples.awkward(spark)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], samples.DOCUMENTS)


@pytest.fixture(scope="session")
def wide(spark):
    return samples.clashing(spark)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
