import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakeledger.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("lakeledger-tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__driver__memory="8g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="lakeledger-tests-"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
