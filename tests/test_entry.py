"""The driver contract holds with and without the training-data subpackage."""

import importlib
import sys


def test_imports_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("govflow.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "govflow.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert names and not any(n.startswith("op") and n[2:3].isdigit() for n in names) and "pipeline" not in names
    assert set(entry.oracle_sql()) <= names
    monkeypatch.delitem(sys.modules, "__spark_entry__")
