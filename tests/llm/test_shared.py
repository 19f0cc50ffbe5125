"""The folder and the tables that cut lineage."""

from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest

from loomline.llm import shared


class Unset:
    def get(self, name, default):
        return default


def test_a_cluster_needs_a_shared_folder():
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    session = SimpleNamespace(conf=Unset(), sparkContext=SimpleNamespace(master="yarn", _jsc=jsc))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_root(session)


def test_threads_write_and_the_setting_is_put_back(spark):
    before = spark.conf.get(shared._CLEANUP, None)

    def one(k):
        return shared.save(spark.range(k * 10), f"t{k}").count()

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(one, range(6))) == [0, 10, 20, 30, 40, 50]
    assert spark.conf.get(shared._CLEANUP, None) == before and shared._writers == 0


def test_dropped_tables_are_gone(spark, tmp_path):
    import os

    df = shared.save(spark.range(3), "gone")
    path = df._loomline_path.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(path)
    shared.drop(df)
    shared.drop(None)
    assert not os.path.exists(path)
