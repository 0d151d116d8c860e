from __future__ import annotations

import uuid

import pytest

from twinkeep.session import local_session, work_path
from twinkeep.sources.sinks import ensure_namespace

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests", **{"spark.driver.memory": "6g"})


@pytest.fixture
def folder(spark):
    return work_path(spark, "test")


@pytest.fixture
def namespace(spark):
    name = f"t_{uuid.uuid4().hex}"
    ensure_namespace(spark, name, work_path(spark, "tables"))
    return name
