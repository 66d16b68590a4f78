"""Every query runs on the smallest tables and gives what its SQL gives."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in sorted(FOLDER.iterdir()):
        db.execute(f"create view {path.stem} as select * from read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return db


def form(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(form(x) for x in value) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    rows = entry.queries()[name](spark, str(FOLDER))
    columns = sorted(rows.columns)
    got = Counter(repr([form(r[c]) for c in columns]) for r in rows.collect())
    if sql := entry.oracle_sql().get(name):
        found = duck.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        want = Counter(repr([form(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in found.fetchall())
        assert got == want
    else:
        assert sum(got.values()) > 0


def test_entry(spark):
    assert entry.entry(spark).columns


def test_core_does_not_need_the_text_corpora():
    for folder, _, files in os.walk(Path(entry.__file__).parent / "loamgrid"):
        for name in files:
            if name.endswith(".py") and not folder.endswith("llm"):
                assert "loamgrid.llm" not in (Path(folder) / name).read_text()
