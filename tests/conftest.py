import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(folder / "checkpoints"))
               .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
               .config("spark.sql.session.timeZone", "America/New_York").getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Rows to a DataFrame; the schema is a DDL string."""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)
