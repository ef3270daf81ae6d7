import pytest

from cellgauge.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(8, "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.checkpoint.dir": shared,
    })
    yield session
    session.stop()
