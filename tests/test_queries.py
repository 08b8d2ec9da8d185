"""Every registered query of the tensor engine against its SQL."""

import pytest

from lattica import catalog

from . import oracle

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.difference(catalog.queries()[name](spark, SF), SQL[name], con) == ""


@pytest.mark.parametrize("name", ["dataset_quantile_approx", "dataset_quantile_kll"])
def test_sketches_are_near(spark, con, name):
    exact = {r["channel"]: r["value"] for r in catalog.queries()["dataset_quantile_exact"](spark, SF).collect()}
    found = {r["channel"]: r["value"] for r in catalog.queries()[name](spark, SF).collect()}
    assert found.keys() == exact.keys() and all(abs(found[c] - exact[c]) < 0.02 for c in exact)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["vec_id", "channel", "y", "x", "value"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_per_sample_normalisation_needs_no_exchange(spark, capsys):
    catalog.queries()["zmuv_sample_channel"](spark, SF).explain()
    assert "Exchange" not in capsys.readouterr().out
