"""A shared local session."""

from __future__ import annotations

import pytest

from tessera.session import session


@pytest.fixture(scope="session")
def spark():
    return session(app="tests", memory="6g")
