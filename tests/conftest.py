import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("tidemark-tests", cores="4", partitions=4, memory="6g")
    yield session
    session.stop()
