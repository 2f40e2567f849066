import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from evidence_spark.session import build_session

    ckpt = tempfile.mkdtemp(prefix="evidence-test-ckpt-")
    spark = build_session(
        master="local[4]",
        shuffle_partitions=4,
        conf={"spark.checkpoint.dir": ckpt, "spark.sql.adaptive.coalescePartitions.minPartitionNum": "1"},
    )
    yield spark
    spark.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="evidence-test-")


def quotes(*items):
    """Build a response text from quote contents."""
    return "\n".join(f"##begin_quote## {q} ##end_quote##" for q in items)
