"""Every query has a name of its own, and each SQL belongs to a query; two of them are compared."""

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = ["p4_found", "g27_degrees", "c13_exists_anti", "h3_bm25", "s18_references"]


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100


def test_entry_runs(spark, sf_dir):
    assert entry.entry(spark).columns == ["id", "calls", "files"]


@pytest.mark.parametrize("name", SMALL)
def test_sql_states_the_same(spark, sf_dir, name):
    con = duckdb.connect()
    for t in "symbols code_chunks edges files sessions subword_stats documents".split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    got = sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect())
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in cursor.fetchall())
    assert sorted(names) == sorted(df.columns) and got == want
