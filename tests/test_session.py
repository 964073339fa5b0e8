from types import SimpleNamespace

import pytest

from tidemark.session import shared_folder


def session(named=None, given=None, master="local[2]", app="a"):
    context = SimpleNamespace(getCheckpointDir=lambda: given, master=master, applicationId=app)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named or default), sparkContext=context)


def test_checkpoint_folder_in_order():
    assert shared_folder(session("/named", "/given")) == "/named"
    assert shared_folder(session(None, "/given", "spark://x")) == "/given"
    own = shared_folder(session(app="one"))
    assert own and shared_folder(session(app="one")) == own != shared_folder(session(app="two"))
    with pytest.raises(RuntimeError):
        shared_folder(session(master="spark://x"))
