import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from glyphweave.session import local, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local("4", 4, "4g")
    ship(session)
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
