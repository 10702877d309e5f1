import pytest

from surfaudit.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """rows(columns, tuples) -> DataFrame, e.g. rows("y int, x int", [(0, 1)])."""
    return lambda schema, data: spark.createDataFrame(data, schema)
