import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quire.session import get_session

    session = get_session("tests", cpus="4", **{"spark.driver.memory": "4g"})
    yield session
    session.stop()
