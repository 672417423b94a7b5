import pytest
DATA = "/root/testdata/sf0.001"

from gaugeworks.plans import catalog, catalog_models, catalog_studies, flagship  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_twin(name, same):
    same(catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(name, spark):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_flagship(spark):
    row = flagship.report(spark, DATA).first()
    assert 0 <= row.auroc <= 1 and row.tp + row.fn == row.n_pos
