import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stages")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_limits(monkeypatch):
    """Make small groups count as heavy, so that the salted and blocked paths run on small fixtures."""
    from tessera.operators import neardup, skew

    monkeypatch.setattr(skew, "HEAVY_MIN_ROWS", 3)
    monkeypatch.setattr(skew, "BLOCK_ROWS", 4)
    monkeypatch.setattr(neardup, "COLD_MAX", 2)
