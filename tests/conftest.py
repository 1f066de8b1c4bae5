import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from vettica.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus(spark):
    """Builds a (path, text) corpus from keyword-like pairs."""

    def build(files):
        return spark.createDataFrame(list(files.items()), "path string, text string")

    return build
