"""Every registered query of the engine against its SQL on the smallest tables."""

import importlib.abc
import sys

import duckdb
import pytest

from siltseek.plans import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, sf, con, name):
    got = engine.QUERIES[name](spark, sf).toPandas()
    if name not in engine.ORACLE_SQL:
        assert len(got)
        return
    want = con.sql(engine.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_entry_works_without_the_subpackage(spark, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    class Gone(importlib.abc.MetaPathFinder):
        """As if the folders were not there."""

        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("siltseek.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("siltseek.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    alone = importlib.reload(entry)
    assert set(alone.queries()) == set(engine.QUERIES) and set(alone.oracle_sql()) == set(engine.ORACLE_SQL)
    monkeypatch.undo()
    importlib.reload(entry)


def test_entry_does_not_hide_import_errors(monkeypatch):
    import __spark_entry__ as entry

    class Broken(importlib.abc.MetaPathFinder):
        def find_spec(self, name, path=None, target=None):
            if name == "siltseek.llm.queries":
                raise ModuleNotFoundError("No module named 'missing_dependency'", name="missing_dependency")

    monkeypatch.delitem(sys.modules, "siltseek.llm.queries", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Broken(), *sys.meta_path])
    with pytest.raises(ModuleNotFoundError, match="missing_dependency"):
        entry._if_there("siltseek.llm.queries", "siltseek.llm")
