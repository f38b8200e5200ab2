import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cardprism.session import get_spark
    shared = str(tmp_path_factory.mktemp("shared"))   # what a cluster names in spark.checkpoint.dir
    s = get_spark(master="local[4]", shuffle_partitions=4, app_name="cardprism-tests", checkpoint_dir=shared)
    yield s
