import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from strata.session import session

    s = session(os.environ.get("TEST_MASTER", "local[4]"), "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def db(spark, tmp_path):
    from strata.database import Database

    return Database(spark, str(tmp_path / "db"))


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
