import os
import pathlib
import sys

import pytest

ROOT = str(pathlib.Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same():
    """Compares a query with its SQL at the smallest scale, as multisets of rows by column name."""
    import duckdb

    con = duckdb.connect()
    for p in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def rows(names, values):
        order = sorted(range(len(names)), key=lambda i: names[i])
        norm = lambda x: round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
        return sorted(names), sorted((tuple(norm(v[i]) for i in order) for v in values), key=repr)

    def check(df, sql):
        got, want = df.collect(), con.execute(sql)
        assert rows(df.columns, got) == rows([c[0] for c in want.description], want.fetchall())

    return check
