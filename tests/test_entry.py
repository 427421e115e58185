import importlib
import sys

import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_works_without_the_subpackage(monkeypatch):
    for name in ("corpus_pipeline", "qacorpus.llm"):
        monkeypatch.setitem(sys.modules, name, None)
    try:
        alone = importlib.reload(entry)
        assert alone.corpus_pipeline is None and "pipeline" not in alone.queries() and "a04_overview" in alone.queries() and not any(k.startswith("op") for k in alone.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
