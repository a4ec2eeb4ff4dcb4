"""What is registered as a query."""

import inspect

import __spark_entry__


def test_helpers_are_not_registered_as_queries():
    queries = __spark_entry__.queries()
    assert {name: list(inspect.signature(f).parameters) for name, f in queries.items() if len(inspect.signature(f).parameters) != 2 or list(inspect.signature(f).parameters)[0] != "spark"} == {}
    assert {"provenance_parse", "numeric_body"} <= set(queries) and "spread" not in queries
