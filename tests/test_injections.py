"""Synthetic maps and defects: streams by row, masks that are what changed, light changes within their bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import injections, photometric
from gaugeworks.plans import catalog, catalog_models, catalog_studies  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", injections.DEFECTS)
def test_masks_are_the_changed_cells(kind):
    for i in range(60):
        shape = [(16, 16), (5, 11), (1, 1), (40, 24)][i % 4]
        for image in (injections.pattern(injections.PATTERNS[i % 3], *shape, injections.stream(1, i)), np.zeros(shape), np.ones(shape)):
            before = image.copy()
            new, mask = injections.defect(image, kind, injections.stream(1, i, 1))
            assert (image == before).all() and mask.any() and (mask == (new != image)).all()
            assert 0 <= new.min() and new.max() <= 1
    sizes = {injections.defect(np.full((16, 16), 0.5), kind, injections.stream(1, i, 1))[1].sum() for i in range(20)}
    assert len(sizes) > 1


def test_patterns_differ_and_names_are_checked():
    a, b, c = (injections.pattern(p, 32, 32, injections.stream(0, 5)) for p in injections.PATTERNS)
    assert a[16].mean() > 2 * a[0].mean() and b[16, 16] > 2 * b[0, 0] and 0 <= c.min() <= c.max() <= 1
    for f in (lambda: injections.pattern("x", 4, 4, injections.stream(0, 0)), lambda: injections.defect(a, "x", injections.stream(0, 0))):
        with pytest.raises(ValueError, match="one of"):
            f()


def test_data_set_is_alike_for_any_partitioning(spark):
    rows = spark.range(40).select("id", F.lit("blob").alias("p"), F.lit("crack").alias("k"))
    make = lambda df: {r.id: (r.x.map, r.x.mask) for r in df.select("id", injections.injected(9, 7, 4)("id", injections.patterned(9, 7, 4)("id", "p"), "k").alias("x")).collect()}
    whole = make(rows.coalesce(1))
    assert make(rows.repartition(7)) == whole and make(rows.where("id = 13"))[13] == whole[13] and whole[1] != whole[2]


def test_synthetic_query(spark):
    got = catalog.QUERIES["synthetic_dataset"](spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/embeddings.parquet").count() and {r.pattern for r in got} == set(injections.PATTERNS) and {r.kind for r in got} == {None, *injections.DEFECTS}
    for r in got:
        assert len(r.map) == len(r.mask) == 256 and any(r.mask) == (r.label == 1)
        if r.kind is None:
            own = injections.pattern(r.pattern, 16, 16, injections.stream(3, r.vec_id))
            assert np.allclose(r.map, own.ravel())


def test_relit_maps_keep_bounds_and_order_of_rows(spark):
    df = spark.createDataFrame([(i, [0.5] * 48) for i in range(30)], "i int, m array<double>").repartition(4)
    get = lambda **k: {r.i: np.array(r.x).reshape(6, 8) for r in df.select("i", photometric.relit(2, **k)("m", F.lit(6), F.lit(8), "i").alias("x")).collect()}
    out = get()
    assert all(0 <= x.min() and x.max() <= 0.5 * 1.2 * 1.2 * 1.3 for x in out.values()) and len({x[0, 0] for x in out.values()}) == 30
    flat = get(slope=0.0, spot=0.0)
    assert all(np.ptp(x) < 1e-12 and 0.3 <= x[0, 0] <= 0.6 for x in flat.values())
    bent = get(spot=0.0, gains=(1.0, 1.0))
    assert all(np.ptp(x) <= 0.5 * 0.4 + 1e-9 for x in bent.values())
