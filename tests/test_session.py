from types import SimpleNamespace

import pytest

from voltloom.session import shared_folder


def fake(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_named_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(fake(master))
    assert shared_folder(fake(master, "hdfs://name/shared/")) == "hdfs://name/shared"
