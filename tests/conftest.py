import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import local_session

    s = local_session(4, shuffle_partitions=4, app="quarry-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def toy_docs(spark):
    return spark.createDataFrame(
        [(1, "solar robot arm"), (2, "robot robot vision system"), (3, "banana leaf disease")],
        "doc_id long, content string")
