from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_query_is_named_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_guard(monkeypatch):
    monkeypatch.setattr(entry, "_training_data", lambda: None)
    assert not any(k.startswith("op") or k == "pipeline" for k in entry.queries())


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data here")
def test_flagship(spark):
    row = entry.entry(spark).first()
    assert row["n"] == 40 and row["n_citing"] <= 40
