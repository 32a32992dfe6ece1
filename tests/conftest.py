import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
os.environ["TOKENIZERS_PARALLELISM"] = "false"

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def same_rows(spark_df, duck_df):
    """Equal columns and rows, in any order."""

    def rows(df):
        df = df[sorted(df.columns)]
        return sorted(tuple("None" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))

    assert sorted(spark_df.columns) == sorted(duck_df.columns)
    assert rows(spark_df) == rows(duck_df)
