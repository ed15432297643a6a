import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(partitions="4")
    yield session
    session.stop()


@pytest.fixture
def tiny_groups(monkeypatch):
    """Buckets and blocks of a few rows, so that small inputs cross many borders."""
    from rvpanel.operators import layout

    monkeypatch.setattr(layout, "DAILY_BUCKET_DAYS", 16)
    monkeypatch.setattr(layout, "BLOCK_ROWS", 8)
