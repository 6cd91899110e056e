"""The checkpoint folder is the session's; without one, only a local session gets a folder of its own."""
from types import SimpleNamespace

import pytest

from navlens import session


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda k, d=None: folder)
    sc = SimpleNamespace(master=master, applicationId=f"app-{master}-{folder}", getConf=lambda: conf,
                         getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None)
    return SimpleNamespace(sparkContext=sc, conf=conf)


def test_a_cluster_names_its_folder():
    assert session.checkpoint_dir(fake("spark://host:7077", "store:/ckpt")) == "store:/ckpt"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(fake("spark://host:7077"))


def test_a_local_session_gets_one_folder():
    local = fake("local[2]")
    assert session.checkpoint_dir(local) == session.checkpoint_dir(local)
