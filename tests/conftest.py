import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))
sys.path.insert(0, str(ROOT / "tests"))

from scene_helpers import SF_DIR  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from bench import session

    return session(8)


@pytest.fixture(scope="session")
def duck():
    from check import connect

    return connect(SF_DIR)

