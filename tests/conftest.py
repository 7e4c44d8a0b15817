import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from lingomark import session

    spark = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Predictors defined in test modules travel with the task; workers cannot import them.
    for name, module in list(sys.modules.items()):
        if name.startswith("test_"):
            cloudpickle.register_pickle_by_value(module)
    yield session.tune(spark)
    spark.stop()


@pytest.fixture(scope="session")
def plan_of():
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return plan
