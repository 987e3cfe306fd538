import pytest

from twinsift.llm.session import prepare


@pytest.fixture(scope="package")
def llm(spark):
    """The session, set up as the registered queries do."""
    prepare(spark)
    return spark


DOCS = "doc_id bigint, text string, source string"


@pytest.fixture(scope="package")
def odd(llm):
    """Nulls, empty and long texts, ties, repeated rows and an extra column of a clashing name."""
    from tests.llm.brute import ODD_DOCS
    from pyspark.sql import functions as F

    return llm.createDataFrame(ODD_DOCS, DOCS).withColumn("n_words", F.lit("mine")).withColumn("score", F.lit(None).cast("int"))


@pytest.fixture(scope="package")
def none(llm):
    return llm.createDataFrame([], DOCS)


@pytest.fixture(scope="package")
def labels(llm):
    return llm.createDataFrame([(i, i % 2, i % 3) for i in range(0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="package")
def given(llm, sf_dir):
    from twinsift.llm.session import table

    return table(llm, sf_dir, "documents").select("doc_id", "text", "source")
