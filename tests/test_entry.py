"""The driver's contract: names, shapes and a smoke run at the smallest size."""

import importlib.util
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("__spark_entry__", os.path.join(ROOT, "__spark_entry__.py"))
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_core_does_not_import_llm():
    for folder, _, files in os.walk(os.path.join(ROOT, "reploom")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "reploom.llm" not in open(os.path.join(folder, f), encoding="utf-8").read()


def test_missing_subpackage_is_left_out(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("reploom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "reploom.llm", None)
    assert "p1_found" in entry.queries() and "p8_ids" not in entry.queries()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
