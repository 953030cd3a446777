import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelspark.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # The checkpoint folder comes from the session (spark.checkpoint.dir); tests name their own.
    s = get_session("local[4]", 8, app="panelspark-tests", extra={
        "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file:{tmp_path_factory.mktemp('shared')}"})
    yield s
    s.stop()
