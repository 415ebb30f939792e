import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tabsynth.session import RECOMMENDED_CONF

    b = SparkSession.builder.master("local[*]").appName("tabsynth-tests").config("spark.sql.shuffle.partitions", "8")
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tabsynth-test-ckpt-"))
    yield s


SF = "/root/testdata/sf0.001"
