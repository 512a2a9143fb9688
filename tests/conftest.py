import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from scriptorium.session import local_session, prepared

    session = local_session("tests", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield prepared(session)
    session.stop()
