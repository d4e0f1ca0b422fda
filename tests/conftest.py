import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from planweave.session import local_session

    return local_session(os.environ.get("TEST_CPUS", "8"), 8)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
