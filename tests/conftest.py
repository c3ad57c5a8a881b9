import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from facetrank.session import DEFAULTS, ensure_checkpoint_dir, ship_package

    b = SparkSession.builder.master("local[4]").appName("facetrank-tests")
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
    # tests have no cluster setting: take a fresh shared folder of their own
    b = b.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="facetrank-test-ckpt-"))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    ship_package(s)
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
