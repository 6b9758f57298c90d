import glob
import os

import duckdb
import pytest

from siltstone.session import get_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="session")
def same():
    def cell(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    def rows(names, values):
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(tuple(cell(r[i]) for i in order) for r in values)

    def check(df, con, sql):
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())

    return check
