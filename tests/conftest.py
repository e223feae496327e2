import pytest

from spliceloom import session


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    session.remove_written(s)
