import pytest

from medialoom.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
