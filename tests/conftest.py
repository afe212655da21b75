import pytest
from pyspark import cloudpickle
from pyspark.sql import SparkSession

import emberlog

cloudpickle.register_pickle_by_value(emberlog)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.ui.retainedExecutions", "2").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(folder)).getOrCreate()
    yield session
    session.stop()
