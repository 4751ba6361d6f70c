"""Every registered query of the engine against its SQL, and those without SQL for their shape."""

from __future__ import annotations

import pytest
from compare import same

from geoloom import catalog

SQL = catalog.oracle_sql()
ROWS_ONLY = sorted(set(catalog.queries()) - set(SQL))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    same(catalog.queries()[name](spark, sf_dir), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry_imports_without_the_optional_subpackage(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name.startswith(("geoloom.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    for m in [m for m in sys.modules if m.startswith(("geoloom.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", refuse)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalog.queries())
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__", None)
