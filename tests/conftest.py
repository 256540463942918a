import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark():
    from parapet.session import local_session

    session = local_session(cores="8", memory="6g", app="parapet-tests")
    yield session
    session.stop()
