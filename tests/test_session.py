import os

import pytest

from weftline.functions import session as S


class Cluster:
    """A session that says it runs on a cluster."""

    class conf:
        get = staticmethod(lambda key, default=None: None)

    class sparkContext:
        master = "spark://host:7077"


def test_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.shared_dir(Cluster)


def test_intermediate_tables_are_removed(spark):
    df = S.materialise(spark.range(5).toDF("x"), "five")
    path = df.inputFiles()[0].removeprefix("file:").replace("//", "/")
    assert df.count() == 5 and os.path.exists(path) and S.scratch_dir(spark).removeprefix("file://") in path
    assert S.release(spark) and not os.path.exists(path)
    assert not S.release(spark)


def test_python_stage_ships_the_package(spark, monkeypatch):
    called = []
    monkeypatch.setattr(S, "ship", called.append)
    assert S.python_stage(spark.range(3), lambda it: it, "id bigint").count() == 3
    assert called == [spark]
