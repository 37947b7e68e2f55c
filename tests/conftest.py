import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from knowloom.session import build_session

    s = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("ckpt")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("wh"))},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
