from __future__ import annotations

from types import SimpleNamespace

import pytest

from twinkeep.session import CHECKPOINT_DIR, shared_dir, work_path


def session(**conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)))


def test_the_named_folder_is_used():
    given = session(**{CHECKPOINT_DIR: "s3a://bucket/work/", "spark.master": "yarn"})
    assert shared_dir(given) == "s3a://bucket/work"
    assert work_path(given, "x") != work_path(given, "x")


def test_a_local_session_may_go_without():
    local = session(**{"spark.master": "local[4]"})
    assert shared_dir(local) == shared_dir(local)


def test_a_cluster_may_not():
    for conf in ({"spark.master": "spark://host:7077"}, {}):
        with pytest.raises(RuntimeError):
            shared_dir(session(**conf))
