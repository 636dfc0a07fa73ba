import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from skillgrid.session import build_session

    s = build_session(8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
