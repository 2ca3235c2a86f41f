import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMOKE = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from panelforge.session import build_session
    s = build_session("local[*]", 8, app_name="panelforge-tests", driver_memory="8g")
    yield s
    s.stop()
