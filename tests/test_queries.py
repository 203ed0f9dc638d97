import duckdb
import pytest

from changeloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_duckdb(spark, oracle, name):
    frame = registry.QUERIES[name](spark, SF)
    cols = sorted(frame.columns)
    got = sorted((tuple(map(plain, r)) for r in frame.select(*cols).collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        return
    names = ", ".join(f'"{c}"' for c in cols)
    want = sorted((tuple(map(plain, r)) for r in oracle.sql(f"SELECT {names} FROM ({registry.ORACLE_SQL[name]})").fetchall()), key=repr)
    assert got == want
