import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from sessionlake.session import create_session

    session = create_session("tests", cpus=4)
    yield session
    session.stop()
