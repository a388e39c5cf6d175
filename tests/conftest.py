import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "4g",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        "spark.ui.showConsoleProgress": "false",
    }
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def multiset(columns, rows):
    """Rows as sorted tuples of text, in order of column names, floats as they are."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(v + 0.0) if isinstance(v, float) else str([show(x) for x in v]) if isinstance(v, list | tuple) else str(v)
    return sorted(tuple(show(r[i]) for i in at) for r in rows)


def same_as_sql(df, duck, sql):
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert multiset(df.columns, df.collect()) == multiset(names, cur.fetchall())
