import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from vecmill.session import build_session

    s = build_session(4, 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def canonical(frame):
    """Rows as sorted tuples of strings, columns by name, floats to nine digits."""
    import pandas as pd

    def one(v):
        if hasattr(v, "__iter__") and not isinstance(v, str | bytes):
            return str([one(x) for x in v])
        if v is None or pd.isna(v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(one, r)) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql):
        got = query(spark, SF).toPandas()
        want = duck.execute(sql).df()
        assert canonical(got) == canonical(want)

    return check
