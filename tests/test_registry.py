"""Names of queries."""

import pytest

from murmuration.queries import ORACLE, QUERIES
from murmuration.registry import query


def test_render_view_is_over_exports():
    assert QUERIES["render_view"].__module__ == "murmuration.queries_ingest"
    assert "聊天记录" in ORACLE["render_view"] and "rendered_messages" in ORACLE


def test_a_name_is_taken_once():
    def render_view(spark, sf):
        raise AssertionError

    with pytest.raises(ValueError):
        query("SELECT 1")(render_view)
    assert QUERIES["render_view"].__module__ == "murmuration.queries_ingest"
