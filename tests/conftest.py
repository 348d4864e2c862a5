from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from impactlens.session import local_session  # noqa: E402
from impactlens.streaming.guards import use_rocksdb  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, **{"spark.ui.showConsoleProgress": "false"})
    use_rocksdb(session)
    yield session
    session.stop()


@pytest.fixture
def rows():
    def take(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return take
