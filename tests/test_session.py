import os

import pytest

from reviewlens import session
from reviewlens.sources.scratch import materialise, release


class _Conf:
    def __init__(self, value=None):
        self.value = value

    def get(self, key, default=None):
        return self.value or default


class _Context:
    def __init__(self, master="local[2]"):
        self.folder = None
        self.master = master

    def getConf(self):
        return _Conf()

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, configured):
        self.conf = _Conf(configured)
        self.sparkContext = _Context()


def test_configured_folder_is_used():
    named = _Session("hdfs://shared/cp")
    assert session.checkpoint_root(named) == "hdfs://shared/cp" == named.sparkContext.folder
    assert session.scratch_path(named, "x").startswith("hdfs://shared/cp/x-")


def test_a_cluster_needs_a_shared_folder():
    unset = _Session(None)
    unset.sparkContext = _Context("spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        session.checkpoint_root(unset)


def test_temporary_folder_only_without_setting():
    unset = _Session(None)
    root = session.checkpoint_root(unset)
    assert os.path.isdir(root) and session.checkpoint_root(unset) == root


def test_materialised_table_is_read_from_the_shared_folder(spark):
    table = materialise(spark.range(5), "numbers")
    root = session.checkpoint_root(spark)
    assert table.count() == 5
    files = table.inputFiles()
    assert all(root in name for name in files)
    from workload import registry

    assert release(spark) >= 1 and not any(os.path.exists(name.removeprefix("file://")) for name in files)
    registry._FLAGS.clear()
