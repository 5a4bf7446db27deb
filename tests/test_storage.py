from __future__ import annotations

from types import SimpleNamespace

import pytest

from lexcheck import storage


def test_batches_are_only_made_smaller(spark):
    before = spark.conf.get(storage.BATCH_ROWS)
    try:
        for given, want in (("10000", "256"), ("100", "100"), ("256", "256"), ("0", "256")):
            spark.conf.set(storage.BATCH_ROWS, given)
            storage.small_batches(spark)
            assert spark.conf.get(storage.BATCH_ROWS) == want
    finally:
        spark.conf.set(storage.BATCH_ROWS, before)


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda name, default=None: default)
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", applicationId="app")
    with pytest.raises(RuntimeError, match="shared folder"):
        storage.scratch_dir(SimpleNamespace(conf=conf, sparkContext=context))
    context.getCheckpointDir = lambda: "/shared/"
    assert storage.scratch_dir(SimpleNamespace(conf=conf, sparkContext=context)) == "/shared/app"


def test_tables_are_written_and_discarded(spark):
    made = storage.materialise(spark.range(5))
    path = made.inputFiles()[0].rsplit("/", 1)[0]
    assert made.count() == 5 and storage.exists(spark, path)
    storage.discard(made)
    assert not storage.exists(spark, path)


@pytest.mark.parametrize(("folder", "name", "whole"), [("/a/", "b", "/a/b"), ("/a", "/b", "/b"), ("s3://x", "y", "s3://x/y"), ("/a", "hdfs://h/b", "hdfs://h/b")])
def test_join(folder, name, whole):
    assert storage.join(folder, name) == whole
