import duckdb
import pytest

from strata import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_has_the_rows_of_its_sql(spark, small, sql, name):
    df = catalog.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    want = sql.sql(catalog.SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "brand"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_depth_first_is_whole_and_starts_at_the_start(spark, small):
    rows = sorted((r["visit_order"], r["id"]) for r in catalog.graph_dfs(spark, small).collect())
    assert [n for n, _ in rows] == list(range(len(rows))) and rows[0][1] == "u0"
