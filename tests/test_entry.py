"""The driver's contract."""

import importlib
import sys

import __spark_entry__ as entry


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 40


def test_without_the_training_data_package(monkeypatch):
    """The rest works where the folders of the training-data package are gone."""
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith("albumspark.llm") else find(n, *a))
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    again = importlib.import_module("__spark_entry__")
    assert not [n for n in again.queries() if n.startswith("op") or n == "pipeline"]


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
