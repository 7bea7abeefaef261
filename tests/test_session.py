"""The shared scratch folder comes from the session; one is made only if unset."""

import pytest

from tripmart import session


class _Conf:
    def __init__(self, v):
        self.v = v

    def get(self, key, default=None):
        return self.v if key == "spark.checkpoint.dir" else default


class _SC:
    def __init__(self, d=None, master="local[4]"):
        self.d, self.set_calls, self.master = d, [], master

    def getCheckpointDir(self):
        return self.d

    def setCheckpointDir(self, d):
        self.set_calls.append(d)
        self.d = d


class _Spark:
    def __init__(self, conf_dir=None, ctx_dir=None, master="local[4]"):
        self.conf, self.sparkContext = _Conf(conf_dir), _SC(ctx_dir, master)


def test_cluster_setting_wins_and_is_not_overridden():
    s = _Spark(conf_dir="hdfs:///shared/ckpt")
    assert session.scratch_root(s) == "hdfs:///shared/ckpt"
    assert s.sparkContext.set_calls == []
    assert session.scratch_dir(s, "x").startswith("hdfs:///shared/ckpt/tripmart/x-")


def test_context_checkpoint_dir_is_used():
    s = _Spark(ctx_dir="file:/shared/ctx")
    assert session.scratch_root(s) == "file:/shared/ctx"
    assert s.sparkContext.set_calls == []


def test_a_folder_is_made_only_when_nothing_is_set():
    s = _Spark()
    root = session.scratch_root(s)
    assert s.sparkContext.set_calls == [root]
    assert session.scratch_dir(s, "a") != session.scratch_dir(s, "a")   # fresh each time


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_the_folder(master):
    s = _Spark(master=master)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(s)
    assert s.sparkContext.set_calls == []
