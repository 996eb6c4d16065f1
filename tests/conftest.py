import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rangeloom.session import session

    s = session("local[8]", 4, "6g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    import oracle

    return oracle.connect(DATA)
