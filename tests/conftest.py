import pytest

from visitlens.session import build


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build(
        "tests",
        **{
            "spark.master": "local[*]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
