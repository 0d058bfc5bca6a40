"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from tallyloom.plans.registered import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


def rows(frame):
    names = sorted(frame.columns)
    plain = frame[names].astype(object).where(frame[names].notna(), None)
    return names, sorted(str([round(x, 9) if isinstance(x, float) and x != int(x) else int(x) if isinstance(x, float) else x for x in r]) for r in plain.values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    assert rows(QUERIES[name](spark, DIR).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())
