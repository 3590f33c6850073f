"""One session for all tests, and the comparison of a query with its SQL."""

import glob
import math
import os

import duckdb
import pytest

from chronolith.session import session

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session(
        "tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="6g", spark__ui__showConsoleProgress="false"
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(v):
    """A value in a form that compares equal between engines."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.6g}")
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, df.collect())


def sql_rows(sql, sf_dir):
    con = duckdb.connect(config={"threads": 4})
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, rows_of(names, cur.fetchall())


@pytest.fixture(scope="session")
def agree(spark):
    def check(query, sql, sf_dir=DATA):
        df = query(spark, sf_dir)
        names, want = sql_rows(sql, sf_dir)
        assert sorted(df.columns) == sorted(names)
        got = spark_rows(df)
        if got != want:
            extra, missing = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
            raise AssertionError(f"{len(got)} rows, {len(want)} expected; only here {extra}; only there {missing}")

    return check
