"""Intermediate tables: where they go, and that they go away."""

import os
from types import SimpleNamespace

import pytest

from graphsieve import workspace


def _session(master, folder=None):
    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=context)


def test_a_cluster_must_name_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            workspace.shared_dir(_session(master))
        assert workspace.shared_dir(_session(master, "hdfs://host/shared")) == "hdfs://host/shared"


def test_scratch_tables_go_at_the_end(spark):
    with workspace.Scratch(spark) as held:
        table = held.written(spark.range(7), "numbers")
        assert table.count() == 7 and os.path.exists(held.paths[0].removeprefix("file://"))
    assert not os.path.exists(held.paths[0].removeprefix("file://"))
    kept = workspace.written(spark.range(3), "kept")
    assert kept.count() == 3


def test_rows_that_take_long_are_spread_by_their_number(spark):
    assert workspace.spread(spark.range(10), 10, 5).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert workspace.spread(spark.range(10), 1000, 10).rdd.getNumPartitions() == 100
