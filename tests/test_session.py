"""Where written intermediates go."""

from types import SimpleNamespace

import pytest

from palisade.session import shared_folder


def session(**conf):
    return SimpleNamespace(conf={f"spark.{k.replace('_', '.')}": v for k, v in conf.items()})


def test_the_named_folder_comes_first():
    made = session(checkpoint_dir="hdfs://a/check", sql_warehouse_dir="file:/w", master="spark://a:7077")
    assert shared_folder(made) == "hdfs://a/check"


@pytest.mark.parametrize("warehouse, master", [
    ("file:/w/", "local[8]"), ("/w", "local-cluster[2,1,1024]"), ("hdfs://a/w", "yarn"), ("s3a://a/w/", "spark://a:7077")])
def test_a_warehouse_that_executors_reach(warehouse, master):
    assert shared_folder(session(sql_warehouse_dir=warehouse, master=master)) == warehouse.rstrip("/") + "/intermediate"


@pytest.mark.parametrize("warehouse", ["file:/w", "file:///w", "/w"])
def test_a_disk_of_the_driver_is_refused_on_a_cluster(warehouse):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session(sql_warehouse_dir=warehouse, master="yarn"))
