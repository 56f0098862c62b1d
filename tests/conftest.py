import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from cellweft.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    settings = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g",
                "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="cellweft-tests-")}
    session = build_session("tests", "local[8]", **settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
