"""Where tables go that cut lineage."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from simloom.scratch import shared_folder


def _session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: folder or other), sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_no_local_folder_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_session(master))
    assert shared_folder(_session(master, "hdfs://x/y/")) == "hdfs://x/y"
