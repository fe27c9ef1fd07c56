import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the workers
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
    }
    spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    """Values as both engines agree on them."""
    if isinstance(value, float) and value != value:
        return None
    return value


@pytest.fixture(scope="session")
def same_rows(duck):
    """Asserts that a frame and SQL give the same columns and rows, in any order."""

    def check(df, sql):
        names = sorted(df.columns)
        found = sorted(repr(tuple(map(plain, r))) for r in df.select(*(f"`{n}`" for n in names)).collect())
        query = duck.execute(sql)
        columns = [d[0] for d in query.description]
        assert sorted(columns) == names
        places = [columns.index(n) for n in names]
        wanted = sorted(repr(tuple(plain(r[i]) for i in places)) for r in query.fetchall())
        assert found == wanted

    return check
