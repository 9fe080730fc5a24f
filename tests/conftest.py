import pytest

from stemloom.session import get_session


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    SparkSession.builder.config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
    s = get_session("tests", "local[4]")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    return s
