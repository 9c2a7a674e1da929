import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quellwerk.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return os.environ.get("QUELLWERK_TESTDATA", "/root/testdata/sf0.001")
