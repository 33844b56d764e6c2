import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lodestitch.session import build

    session = build("local[4]", 4, "tests", **{"spark.default.parallelism": "4", "driver_memory": "4g"})
    yield session
    session.stop()
