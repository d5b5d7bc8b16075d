import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TESTDATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    out = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


@pytest.fixture(scope="session")
def small():
    folder = TESTDATA / "sf0.001"
    if not folder.exists():
        pytest.skip("no test data")
    return str(folder)


@pytest.fixture(scope="session")
def same_as_sql():
    """Runs a query and its SQL on the same tables and compares the rows."""
    import duckdb

    def check(spark, folder, query, sql):
        con = duckdb.connect()
        for p in Path(folder).iterdir():
            con.execute(f"create view {p.stem} as select * from '{p}'")
        got = query(spark, folder).toPandas()
        want = con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)

        def cell(x):
            if x is None or str(x) in ("<NA>", "NaT", "nan"):
                return "~"
            if isinstance(x, float):
                return f"{x:.6g}"
            return str(list(x)) if hasattr(x, "tolist") and getattr(x, "ndim", 0) else str(x)

        rows = lambda df: sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].values.tolist())
        assert rows(got) == rows(want)

    return check
