import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])

from quillspark.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
