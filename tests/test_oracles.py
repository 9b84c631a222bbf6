"""Every query with SQL against DuckDB, which runs in a process of its own."""

import pickle
import subprocess
import sys

import pytest

import __spark_entry__ as entry

NAMES = sorted(q for q in entry.queries() if q in entry.oracle_sql())
RUN = """
import os, pickle, sys
import duckdb
d, out, sql = sys.argv[1], sys.argv[2], pickle.load(open(sys.argv[3], 'rb'))
c = duckdb.connect()
for f in os.listdir(d):
    if f.endswith('.parquet'):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{d}/{f}'")
found = {}
for name, text in sql.items():
    r = c.execute(text)
    found[name] = ([x[0] for x in r.description], r.fetchall())
pickle.dump(found, open(out, 'wb'))
"""


@pytest.fixture(scope="session")
def expected(sf_dir, tmp_path_factory):
    d = tmp_path_factory.mktemp("oracle")
    (d / "sql").write_bytes(pickle.dumps(entry.oracle_sql()))
    subprocess.run([sys.executable, "-c", RUN, sf_dir, str(d / "out"), str(d / "sql")], check=True)
    return pickle.loads((d / "out").read_bytes())


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order)) for r in table)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, expected, name):
    df = entry.queries()[name](spark, sf_dir)
    columns, table = expected[name]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, table)


def test_entry(spark):
    assert entry.entry(spark).count() == 24
