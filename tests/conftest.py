from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from forgemart.session import local_session  # noqa: E402

DATA = os.environ.get("FORGEMART_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.cpu_count() or 2, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return DATA
