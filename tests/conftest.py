import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_codebook(spark):
    from pyspark.sql import functions as F

    from codeloom.functions.codes import code_description

    rows = [(0, "A1", "Salary", "A", "Money", False), (1, "A2", "Bonus", "A", "Money", False), (2, "B1", "Office", "B", "Place", False)]
    df = spark.createDataFrame(rows, "order bigint, code string, name string, parent_code string, parent_name string, is_parent boolean")
    return df.withColumn("description", code_description(F.col("code"), F.col("parent_name"), F.col("name")))
