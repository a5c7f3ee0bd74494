import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from campusflow.session import checkpoint_dir, get_session
    shared = str(tmp_path_factory.mktemp("shared"))
    s = get_session("local[4]", app="campusflow-tests", shuffle_partitions=8,
                    extra={"spark.sql.warehouse.dir": shared,
                           "spark.cleaner.referenceTracking.cleanCheckpoints": "true"})
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
