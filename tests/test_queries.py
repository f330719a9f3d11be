"""Every registered query runs; those with an oracle give DuckDB's rows."""

from __future__ import annotations

import sys

import oracle
import pytest
from panelworks.plans import queries_more  # noqa: F401
from panelworks.plans.queries import ORACLE_SQL, QUERIES

@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    if name in ORACLE_SQL:
        assert oracle.compare(spark, QUERIES[name], ORACLE_SQL[name], sf_dir) == ""
    else:
        assert QUERIES[name](spark, sf_dir).columns


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_other_queries_work_without_the_corpus_operators(monkeypatch):
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith(("panelworks.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    for hidden in ("public_tokenizers", "panelworks.llm.queries"):  # what the pipeline needs, then all of it
        monkeypatch.setitem(sys.modules, hidden, None)
        assert set(QUERIES) <= set(entry.queries()) and "pipeline" not in entry.queries()
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE_SQL)
