import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cuewright import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    own = session.build("tests", cores=4, shuffle_partitions=4)
    own.sparkContext.setLogLevel("ERROR")
    yield own
    own.stop()
