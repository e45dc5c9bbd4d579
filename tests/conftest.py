import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paperloom.plans.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("paperloom-tests", master="local[8]", partitions=3)
    session.sparkContext.setLogLevel("ERROR")
    # Small inputs: compiling a plan takes longer than interpreting it.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
