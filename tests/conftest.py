from __future__ import annotations

import pytest

from pricelake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(app="tests", shuffle=4)
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"
