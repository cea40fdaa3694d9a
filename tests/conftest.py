import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest

import check


@pytest.fixture(scope="session")
def spark():
    return check.session("4", "4")


@pytest.fixture(scope="session")
def folder():
    return f"{check.ROOT}/sf0.001"


@pytest.fixture(scope="session")
def tables(spark, folder):
    from catalog.registry import Tables

    return Tables(spark, folder)
