import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from arborline.session import build_session

    s = build_session("local[8]", "tests", **{"spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rounded(v):
    import datetime
    import decimal

    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(rounded, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def same_as_oracle(df, sql, sf_dir=None, **views):
    """The rows of df equal those of DuckDB over the tables of a folder or over given frames."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES if sf_dir else ():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, frame in views.items():
        con.register(name, frame)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    want = sorted(repr(tuple(rounded(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    got = sorted(repr(tuple(rounded(r[c]) for c in cols)) for r in df.collect())
    assert got == want
