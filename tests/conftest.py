import pytest

from flowgauge.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("flowgauge-tests", "8", **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
