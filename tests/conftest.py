import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from touchline.session import get_session

    session = get_session("local[4]", "touchline-tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__default__parallelism="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    folder = os.environ.get("TOUCHLINE_TESTDATA", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    return folder
