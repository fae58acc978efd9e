import os

import pytest

from tracecast.storage import _written, materialize, new_path, release, work_dir


def test_tables_live_in_the_shared_folder(spark, monkeypatch):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    app, kept = spark.sparkContext.applicationId, dict(_written)
    _written.clear()
    table = materialize(spark.range(3).selectExpr("id as case_id", "array('a') as acts"), "t")
    (path,) = _written[app]
    assert table.count() == 3 and os.path.dirname(path) == work_dir(spark) and os.path.exists(path)
    assert new_path(spark, "x") != new_path(spark, "x")
    release(spark)
    assert not os.path.exists(path) and app not in _written
    _written.update(kept)


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(Session())
