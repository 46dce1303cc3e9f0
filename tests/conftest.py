from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from strophe.session import local_session, shared_dir  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", "strophe-tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    shared_dir(s)
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF
