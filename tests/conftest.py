import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(df):
    """Rows as sorted text, by column name, with numbers to four places."""
    import pandas as pd

    cols = sorted(df.columns)

    def one(v):
        if pd.isna(v):
            return "None"
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{round(float(v), 4):.4f}"
        except (TypeError, ValueError):
            return str(v).replace(" 00:00:00", "")

    return cols, sorted(tuple(one(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def compare(spark, sf, duck):
    def run(query, sql):
        got, want = plain(query(spark, sf).toPandas()), plain(duck.sql(sql).df())
        assert got[0] == want[0]
        assert got[1] == want[1]

    return run
