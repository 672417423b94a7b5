import glob
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from gaugeworks.session import session

    s = session("local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="4g", spark_ui_showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a query and its twin give the same rows."""

    def check(query, sql):
        df = query(spark, DATA)
        own = sorted(repr([plain(x) for _, x in sorted(zip(df.columns, row, strict=True))]) for row in df.collect())
        r = duck.execute(sql)
        names = [d[0] for d in r.description]
        other = sorted(repr([plain(x) for _, x in sorted(zip(names, row, strict=True))]) for row in r.fetchall())
        assert sorted(df.columns) == sorted(names)
        assert own == other

    return check
