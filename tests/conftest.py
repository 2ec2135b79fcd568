import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TW_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tabwright.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=8,
                  extra={"spark.driver.memory": "4g", "spark.sql.codegen.wholeStage": "true"})
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF
