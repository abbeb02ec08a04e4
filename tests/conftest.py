import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "ledgerloom-tests",
        master="local[8]",
        shuffle_partitions=4,
        spark__ui__enabled="false",
        spark__sql__session__localRelationCacheThreshold="67108864",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
