import pytest


@pytest.fixture(scope="session")
def spark():
    from tracelake.session import get_session

    s = get_session(master="local[4]", app="tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
