import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="tessera-test-ckpt-")
    s = get_spark("local[4]", 4, extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "8g"})
    # small buckets so the split-group path of the running totals runs in tests
    s.conf.set("tessera.prefix.rowsPerBucket", "500")
    yield s
