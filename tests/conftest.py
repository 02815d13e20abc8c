import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def compare(spark, sf_dir, run, sql):
    """Rows of a query and of its SQL, in one order."""
    import duckdb

    con = duckdb.connect()
    for path in Path(sf_dir).iterdir():
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    result = con.execute(sql)
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    a = sorted(str([plain(v) for v in row]) for row in df.select(*(f"`{n}`" for n in names)).collect())
    b = sorted(str([plain(row[found.index(n)]) for n in names]) for row in result.fetchall())
    return a, b
