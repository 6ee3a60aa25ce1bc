import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sieverank.session import ensure_checkpoint_dir, get_session

    session = get_session("tests", "8", 8)
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    return session
