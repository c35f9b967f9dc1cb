import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(Path(__file__).resolve().parent)]

from millrace.session import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return make_session("tests", cores=8, shuffle_partitions=4)
