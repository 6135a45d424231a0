import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quernstone.session import open_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return open_session(8, spark__sql__shuffle__partitions="4")
