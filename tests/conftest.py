import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from clearwell.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def people(spark):
    """Five members: one entered twice, one without a name, a broken address, an age that is missing and one absurd."""
    rows = [
        (11, " Ines ", "ines@mail.example", 41, 60.0),
        (12, "RAUL", "raul(at)mail", None, 70.0),
        (14, "Mina", "mina@mail.example", 340, None),
        (14, "Mina", "mina@mail.example", 340, None),
        (17, None, "theo@mail.example", 28, 90.5),
    ]
    return spark.createDataFrame(rows, "id bigint, name string, email string, age bigint, score double")


@pytest.fixture
def stock(spark):
    """Shelf counts without a fault."""
    rows = [(f"sku-{i:02d}", i * 3 % 11, "north" if i % 2 else "south") for i in range(1, 13)]
    return spark.createDataFrame(rows, "sku string, pieces bigint, hall string")


@pytest.fixture
def bad_stock(stock):
    """Two shelves twice, a missing sku, a negative and a huge count, halls mostly unknown."""
    from pyspark.sql import functions as F

    n = F.regexp_extract("sku", r"(\d+)$", 1).cast("int")
    damaged = stock.select(
        F.when(n != 12, F.col("sku")).alias("sku"),
        F.when(n == 3, -4).when(n == 4, 5000).otherwise(F.col("pieces")).alias("pieces"),
        F.when(n < 5, F.col("hall")).alias("hall"),
    )
    return damaged.unionByName(damaged.where("sku in ('sku-01', 'sku-02')"))
