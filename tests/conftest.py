import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from touchline.session import drop_stored, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8")
    yield session
    drop_stored(session)
    session.stop()


@pytest.fixture()
def small_chunks(monkeypatch):
    """Cut every sequence into tiny chunks so that borders are crossed everywhere."""
    from touchline.operators import sequences

    monkeypatch.setattr(sequences, "CHUNK_ROWS", 7)
