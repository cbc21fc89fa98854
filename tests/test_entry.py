import __spark_entry__
import duckdb
import os
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the tables aren't here")


def shown(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str([shown(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def reference_names():
    from cuesift.plans.queries import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", reference_names())
def test_query_against_sql(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    rows = df.collect()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(shown(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(shown(r[c]) for c in sorted(names)) for r in rows) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
