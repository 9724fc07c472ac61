"""Where intermediate tables go."""

import pytest

from strandlake import session
from strandlake.schema import EngineError


class _Conf(dict):
    def set(self, k, v):
        self[k] = v


class _Session:
    """A session of another master, without starting one."""

    def __init__(self, master, **conf):
        self.conf = _Conf()
        self.sparkContext = type("Context", (), {"master": master, "getConf": lambda _: conf})()


def test_shared_folder():
    with pytest.raises(EngineError):
        session.shared_dir(_Session("spark://host:7077"))
    with pytest.raises(EngineError):
        session.shared_dir(_Session("yarn"))
    assert session.shared_dir(_Session("yarn", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    one = _Session("local[4]")
    assert session.shared_dir(one) == session.shared_dir(one)


def test_intermediates_are_dropped(spark):
    with session.intermediates():
        kept = session.materialize(spark.range(5), "t")
        path = kept.inputFiles()[0]
        assert kept.count() == 5
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_broadcast_is_measured_in_bytes(spark):
    hint = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    df = spark.range(10).selectExpr("id", "repeat('x', 1000) x")
    assert hint(session.broadcast_if_small(df)) and not hint(session.broadcast_if_small(df, max_bytes=5000)) and not hint(session.broadcast_if_small(df, max_rows=9))
