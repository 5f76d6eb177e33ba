import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kinframe.session import build_local
    s = build_local(4, 4, app="kinframe-tests")
    yield s
    s.stop()
