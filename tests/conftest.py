import pytest
from pyspark.sql import SparkSession

from weekpanel.session import configure


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = configure(SparkSession.builder.master("local[*]").appName("weekpanel-tests"))
    session = (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def settings(spark):
    """Set session settings for one test."""
    before = {}

    def change(**values):
        for name, value in values.items():
            name = name.replace("__", ".")
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield change
    for name, value in before.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


def plan_of(df, run=False):
    """Text of the physical plan; with ``run``, the one that adaptive execution ended with."""
    if run:
        df.write.format("noop").mode("overwrite").save()
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def physical_plan():
    return plan_of
