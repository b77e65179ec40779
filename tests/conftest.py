from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vialume.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    return build_session("local[8]", 8, spark__checkpoint__dir=f"file://{shared}")
