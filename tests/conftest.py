import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidegate import session

    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    return session.local(4, 4, "4g", **{"spark.ui.showConsoleProgress": "false", "spark.sql.streaming.stateStore.providerClass": provider})


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA
