import pytest

from tests.llm import odd


@pytest.fixture(scope="session")
def rows():
    return odd.make_rows()


@pytest.fixture(scope="session")
def docs(spark):
    return odd.odd_docs(spark).cache()
