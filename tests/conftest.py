import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from passages.session import local_session, ship_with_tasks  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    ship_with_tasks()
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture
def rng():
    return random.Random(7)
