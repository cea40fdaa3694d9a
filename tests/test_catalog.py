"""Every registered query against its SQL on the smallest tables (all of them at sf0.01: python tests/check.py 0.01)."""

import check
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# model fits run in test_models.py
NAMES = [n for n in QUERIES if not n.startswith("m") or n in ("m12_training_frame", "m7_m8_gate_rules")]


@pytest.fixture(scope="module")
def con(folder):
    return check.duck(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, con, folder):
    rows, _, verdict = check.compare(spark, con, QUERIES[name], ORACLES.get(name), folder)
    assert not verdict, verdict


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["rows", "top_decile", "bottom_decile", "spread"]
