import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallyforge.session import session

    shared = tmp_path_factory.mktemp("shared").as_uri()
    s = session("local[4]", 4, **{"spark.checkpoint.dir": shared})
    s.sparkContext.setCheckpointDir(shared)
    yield s
    s.stop()
