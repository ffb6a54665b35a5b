"""Layer 1: every query with an oracle matches DuckDB (columns, rows, values)."""

import pytest

from conftest import SF_SMALL
from wingwatch.plans.catalog import ORACLE, load_all
from wingwatch.plans.oracle_check import compare, duck

load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, name, SF_SMALL, con)
    assert res["status"] == "ok", res


def test_entry_smoke(spark):
    import importlib.util
    import os

    from conftest import ROOT

    spec = importlib.util.spec_from_file_location("entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0
    assert set(mod.queries()) >= set(mod.oracle_sql())
