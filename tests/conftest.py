import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from vigilo.session import build_session
    session = build_session("local[4]", app="vigilo-tests", shuffle_partitions=8,
                            driver_memory="8g")
    yield session
    session.stop()
