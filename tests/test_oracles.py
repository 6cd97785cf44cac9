"""Every query runs; every one with SQL gives what DuckDB gives."""

import pytest

from lodestone.plans import registries
from tools.compare import compare, duck

CORE = {k: (v, r.sql.get(k)) for r in registries() for k, v in r.queries.items()}


#: Queries that SQL can't say, and the tests of what they are made of.
TESTED = {
    "python_ast_chunks": "test_syntax_chunks", "syntax_chunk_kinds": "test_syntax_chunks", "identifier_references": "test_used_names_leave_out_comments_and_strings", "fenced_python_check": "test_fenced_blocks_that_parse",
    "block_emission": "test_blocks_never_exceed_the_budget", "multi_query_variants": "test_variants_of_a_query", "multi_query_rrf": "test_variants_of_a_query", "repo_scope_mask": "test_longest_name_first",
    "retrieve_batch": "test_retrieve_within_budget", "graph_expansion": "test_call_graph_adds_callers_once", "graph_build": "test_extraction_in_every_language",
}


def test_every_query_has_sql_or_a_test_of_its_own():
    import os

    here = os.path.dirname(os.path.abspath(__file__))
    written = open(os.path.join(here, "test_operators.py")).read()
    without = {k for k, (_, sql) in CORE.items() if not sql}
    assert without == set(TESTED)
    assert all(f"def {t}(" in written for t in TESTED.values())


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, data, con, name):
    said = compare(spark, con, data, name, *CORE[name])
    assert said.startswith("ok" if CORE[name][1] else "rows"), said
    assert CORE[name][1] or not said.startswith("rows 0 "), said


def test_entry_point_lists_every_core_query():
    import __spark_entry__ as e

    assert set(CORE) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
