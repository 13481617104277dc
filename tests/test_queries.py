"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from compare import compare, data_dir, duck
from tessera.plans import catalog

FOLDER = data_dir(os.environ.get("TEST_SF", "0.001"))


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    text, ok = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES.get(name), FOLDER)
    assert ok, text


def test_every_inventory_row_has_a_query():
    have = {i for ids in catalog.SURVEY.values() for i in ids}
    sizes = dict(S=11, N=18, Q=21, D=17, J=9, R=23, A=20, E=30, M=14, T=4, W=17, X=6)
    assert {f"{k}{i}" for k, n in sizes.items() for i in range(1, n + 1)} <= have
