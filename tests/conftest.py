import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
SF1 = "/root/testdata/sf0.1"


@pytest.fixture(scope="session")
def spark():
    from vecreduce.session import local_session

    s = local_session(8, shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="vecreduce-tests-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck01():
    from vecreduce.plans.verify import duck_connection

    return duck_connection(SF01)
