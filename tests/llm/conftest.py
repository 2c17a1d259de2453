import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def docs(spark):
    """docs([text, ...]) or docs([(id, text), ...]): documents with extra columns of unlucky names."""

    def build(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "x", "y", "z", 1) for i, t in rows]
        return spark.createDataFrame(
            rows, "doc_id long, text string, _quality string, _spans string, _secrets string, _row int"
        )

    return build


@pytest.fixture(scope="module")
def real(spark):
    if not os.path.isdir(SF):
        pytest.skip("driver tables not present")
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
