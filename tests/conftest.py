import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from carelake.session import DEFAULT_CONF

    b = SparkSession.builder.master("local[*]").appName("carelake-tests").config("spark.sql.shuffle.partitions", "8")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="carelake-test-ckpt-", dir="/tmp"))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    from carelake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="carelake-test-", dir="/tmp")
