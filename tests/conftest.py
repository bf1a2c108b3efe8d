import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from alertloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    if not os.path.isdir(SMALL):
        pytest.skip("test data is not there")
    return SMALL


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column builder on literal inputs: one(builder, value, ...)."""
    from pyspark.sql import functions as F

    def evaluate(build, *values):
        cols = [F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]) for v in values]
        # A filter on a generated value keeps the optimizer from folding the call away entirely.
        row = spark.range(1).select(build(*cols).alias("out")).first()
        return row["out"].asDict(True) if hasattr(row["out"], "asDict") else row["out"]

    return evaluate
