import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from sf_paths import SF_ORACLE, SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from moderata.session import build_session

    s = build_session("local[*]", shuffle_partitions=8, app="moderata-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from oracle_harness import duck

    return duck(SF_SMALL)


@pytest.fixture(scope="session")
def duck_oracle():
    from oracle_harness import duck

    return duck(SF_ORACLE)
