import pytest




@pytest.fixture(scope="session")
def frame(spark):
    """Makes a documents frame, with the columns given."""

    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make
