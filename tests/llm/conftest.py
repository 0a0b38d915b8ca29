import pytest

WORDS = "the of and to in thread ling onder essing ration ble ster wound harbor silent copper mirror window garden river stone letter market winter summer forest engine paper candle".split()


@pytest.fixture
def make_docs(spark):
    def make(rows, more=""):
        return spark.createDataFrame(rows, "doc_id long, text string" + more)

    return make
