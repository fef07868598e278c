import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from tracemill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "3g", **{"spark.sql.shuffle.partitions": "3"})
    yield session
    session.stop()
