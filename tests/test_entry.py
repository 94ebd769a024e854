"""The entry module: every query against its SQL on the smallest tables, and life without the training-data package."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from csvloom.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def canonical(rows):
    return sorted(tuple(repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.sql(queries.ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    pick = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"select {pick} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert canonical(map(tuple, df.select(*columns).collect())) == canonical(want)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_entry_works_without_the_training_data_package(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("csvloom", "__spark_entry__.py"):
        os.symlink(os.path.join(root, name), tmp_path / name) if name != "csvloom" else None
    package = tmp_path / "csvloom"
    package.mkdir()
    for name in os.listdir(os.path.join(root, "csvloom")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(root, "csvloom", name), package / name)
    code = "import __spark_entry__ as e; assert 'native_sum_by_flag' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
