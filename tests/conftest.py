import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from evalcrate.session import get_spark
    s = get_spark("local[4]", extra={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g"})
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"
