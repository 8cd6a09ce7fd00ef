import os

import pytest

from sonarmill.session import bounded_batches, cut, free, shared_dir


class _Conf:
    def get(self, key, default):
        return default


class _Cluster:
    conf = _Conf()

    class sparkContext:
        master = "spark://host:7077"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Cluster())


def test_freed_tables_are_gone(spark):
    table = cut(spark.range(5).toDF("x"), "freed")
    where = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(where)
    free(table)
    assert not os.path.exists(where)


def test_batches_are_bounded_but_lower_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        bounded_batches(spark)
        assert spark.conf.get(key) == "1000"
        spark.conf.set(key, "50")
        bounded_batches(spark)
        assert spark.conf.get(key) == "50"
    finally:
        spark.conf.set(key, before)
