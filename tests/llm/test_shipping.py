"""Corpus operators where the executors hold no copy of the package."""

import os

import pytest

from massloom.llm.entry import QUERIES
from tests.far import failures

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_operators_need_no_package_on_the_executors():
    assert failures(DATA, [*QUERIES, "pipeline"]) == ""
