import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from driftwell.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session(8, "driftwell-tests")


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
