import pytest

from pulseweave.llm.common import prepare


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)
