import pytest
from pyspark.sql import Row

from doubtful_rows import SCHEMA, SF, TEXTS


@pytest.fixture(scope="session")
def documents(spark):
    def frame(texts):
        return spark.createDataFrame([Row(i, t, None, "s", None, *["x"] * 11) for i, t in texts], SCHEMA)

    return frame


@pytest.fixture(scope="session")
def doubtful(documents):
    return documents(TEXTS).repartition(3)


@pytest.fixture(scope="session")
def empty(documents):
    return documents([])


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
