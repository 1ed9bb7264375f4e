import datetime
import decimal
import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from marginalia.session import SETTINGS  # noqa: E402

DATA = Path(os.environ.get("MARGINALIA_DATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    with tempfile.TemporaryDirectory() as folder:
        session = builder.config("spark.checkpoint.dir", f"file://{folder}/checkpoints").config("spark.sql.warehouse.dir", f"{folder}/warehouse").getOrCreate()
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()


@pytest.fixture(scope="session")
def tiny():
    folder = DATA / "sf0.001"
    if not folder.exists():
        pytest.skip("no test data")
    return str(folder)


def plain(v):
    """A cell as both engines show it."""
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(df, *columns):
    """Rows as sorted tuples, nulls first."""
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


@pytest.fixture(scope="session")
def rows():
    return rows_of
