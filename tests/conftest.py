import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from codestrata.session import configure

    session = (
        configure(SparkSession.builder.master("local[4]").appName("tests"))
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """Files table from a dict of path -> text."""
    from codestrata.sources.tables import files_from_table

    def build(files: dict):
        rows = [(p, c) for p, c in files.items()]
        return files_from_table(spark.createDataFrame(rows, "path string, content string"))

    return build
