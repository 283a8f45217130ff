"""Every registered query against its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import compare

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result, _ = compare(spark, name, QUERIES[name], ORACLES.get(name), SF, con)
    assert result.startswith("ok") or result.startswith("rows-only"), result


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_a_broken_module_is_not_taken_for_a_missing_one(tmp_path, monkeypatch):
    (tmp_path / "broken_package").mkdir()
    (tmp_path / "broken_package" / "__init__.py").write_text("")
    (tmp_path / "broken_package" / "queries.py").write_text("import no_such_module_at_all\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert entry._there("broken_package.queries")
    assert not entry._there("broken_package.other") and not entry._there("no_such_package.queries")
