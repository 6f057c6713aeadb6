"""The registered text queries over the smallest tables, with their SQL twins."""

import pytest

from querymill.llm.queries import LLM
from tests.test_queries import check, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(LLM.queries))
def test_query(spark, duck, name):  # noqa: F811
    check(spark, duck, name)
