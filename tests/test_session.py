"""Session helpers: cluster sizing and the shared checkpoint folder."""

from types import SimpleNamespace

import pytest

from muster.session import checkpoint_dir, cluster_conf, pin


def test_cluster_conf_sizes_partitions_by_volume():
    small = cluster_conf(1 << 30, 64)
    big = cluster_conf(100 << 40, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 128  # never under two waves
    assert int(big["spark.sql.shuffle.partitions"]) == 204_800
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert "spark.checkpoint.dir" not in big


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_unset_checkpoint_folder_on_a_cluster_raises(master):
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError):
        checkpoint_dir(session)


def test_pin_uses_the_session_checkpoint_folder(spark):
    folder = checkpoint_dir(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    assert pin(spark.range(5)).count() == 5
